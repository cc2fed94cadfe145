import json

import pytest

from colloquy.operators import agent, evidence, graph
from colloquy.operators import ingest
from colloquy.operators import provenance as prov
from colloquy.functions import models
from colloquy.sources import sinks, tables


def test_json_and_questions(spark, tmp_path):
    q = [{"question_id": "q1", "haystack_session_ids": ["s1", "s2"], "haystack_dates": ["a", "b"], "haystack_sessions": [[{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], []]}]
    (tmp_path / "q.json").write_text(json.dumps(q))
    got = tables.flatten_questions(tables.json_array(spark, str(tmp_path / "q.json"))).collect()
    assert [(r.session_id, r.turn_index, r.role) for r in got] == [("s1", 1, "user"), ("s1", 2, "assistant")]
    q[0]["haystack_dates"] = ["a"]
    (tmp_path / "bad.json").write_text(json.dumps(q))
    with pytest.raises(Exception, match="differ in length"):
        tables.flatten_questions(tables.json_array(spark, str(tmp_path / "bad.json"))).collect()
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in tables.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]


def test_samples_and_aliases(spark):
    turns = json.dumps([{"speaker": "A", "text": "x\ny", "blip_caption": None, "dia_id": "D2:1"}, {"speaker": "", "text": "", "dia_id": "D2:2"}, {"speaker": "B", "text": "z", "blip_caption": "cat", "dia_id": "D2:3"}])
    df = spark.createDataFrame([("s", {"session_2": turns, "session_10": "[]", "speaker_a": "A"})], "sample string, conversation map<string,string>")
    assert [(r.session, r.pos, r.dia_id, r.line) for r in tables.flatten_samples(df).collect()] == [(2, 0, "D2:1", "A: x y"), (2, 1, "D2:3", "B: z (Image: cat)")]
    qa = spark.createDataFrame([(None, "t?", '["D1:3"]', "2"), ("q?", None, "D1:4", "9")], "Question string, trigger string, evidence string, category string")
    got = tables.normal_questions(qa).collect()
    assert [(r.question, r.evidence, r.category) for r in got] == [("t?", ["D1:3"], "temporal"), ("q?", ["D1:4"], "Unknown")]


def test_csv(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = ",".join(f.name for f in tables.TURN_ROW)
    (tmp_path / "in" / "a.csv").write_text(f'{head}\nq,t,s1,1,user,"hi, ""you""\nthere",d,?,a,d,true,false,"[]"\nq,t,s1,2,assistant,  ,d,?,a,d,false,false,"[]"\nq,t,s1,x,assistant,ok,d,?,a,d,false,false,"[]"\n')
    got = tables.csv_turns(spark, str(tmp_path / "in"), recursive=True).orderBy("pos").collect()
    assert [(r.pos, r.turn_index, r.content) for r in got] == [(0, 1, 'hi, "you"\nthere'), (1, None, "ok")]
    assert tables.first_rows(tables.csv_turns(spark, str(tmp_path / "in"))).count() == 1
    assert [r["sample"] for r in tables.runs(spark, str(tmp_path)).collect()] == ["a"]
    assert len(tables.file_digests(spark, str(tmp_path / "in")).first().sha256) == 64


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "id int, part string, v string")
    made = {r.part: r.rows for r in sinks.with_manifest(df, f"{tmp_path}/m", "part", "v1").collect()}
    assert made == {"a": 2, "b": 1} and sinks.is_complete(spark, f"{tmp_path}/m", "v1") and not sinks.is_complete(spark, f"{tmp_path}/m", "v2") and not sinks.is_complete(spark, f"{tmp_path}/none", "v1")
    sinks.append_records(df, f"{tmp_path}/log", "answers")
    sinks.append_records(df.limit(1), f"{tmp_path}/log", "answers")
    assert spark.read.json(f"{tmp_path}/log/answers").count() == 4
    with pytest.raises(ValueError):
        sinks.append_records(df, f"{tmp_path}/log", "anything")
    for numbers, want in (([], (0, 0)), ([2, 3], (0, 1)), ([1, 2, 3, 3], (3, 0)), ([1], (1, 0)), ([-1, 0, 1, 5], (1, 1))):
        assert tuple(sinks.latest_gapless(spark.createDataFrame([(n,) for n in numbers], "number int")).first()) == want
    s = sinks.latest_gapless(spark.createDataFrame([(1,), (2,), (4,)], "number int")).first()
    assert (s.highest, s.after_gap) == (2, 1)
    assert sinks.masked({"API_KEY": "x", "dim": "3"}) == {"API_KEY": "***", "dim": "3"}
    sinks.export_jsonl(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 3


def test_ingest(spark):
    text = 'entity|Ann|person|a friend\nEntity | Rome || \nfoo\nrelationship|Ann|Rome|lives in'
    assert ingest.lenient_lines(text)[0] == ("entity", "Ann", "Person", "a friend") and len(ingest.lenient_lines(text)) == 2
    new = spark.createDataFrame([("d", "last Tuesday [DATE: 2023-02-14]", "Date"), ("d", "Ann", "Person")], "k string, name string, type string")
    hints = spark.createDataFrame([("d", "last tuesday", "2023-02-14"), ("d", "yesterday", "2023-02-17")], "k string, phrase string, display string")
    assert {(r.name, r.type) for r in ingest.repair_dates(new, hints, "k").collect()} == {("2023-02-14", "Date"), ("Ann", "Person"), ("2023-02-17", "Date")}
    edges = spark.createDataFrame([("d", "Ann", "Bob"), ("d", "Ann", "Zed")], "k string, source string, target string")
    res = spark.createDataFrame([("d", "Ann", "p1", 1), ("d", "Ann", "p9", 2), ("d", "Bob", "p2", 1)], "k string, name string, id string, n int")
    ok, bad = ingest.resolve_endpoints(edges, res, "k")
    assert [(r.source_id, r.target_id) for r in ok.collect()] == [("p1", "p2")] and bad.count() == 1


def test_graph_fixture(spark):
    v = spark.createDataFrame([(f"e{i}", f"E{i}") for i in range(1, 9)], "id string, name string")
    e = spark.createDataFrame([("e1", "r1", "e2"), ("e2", "r2", "e3"), ("e3", "r3", "e4"), ("e4", "r4", "e5"), ("e5", "r5", "e6"), ("e1", "r6", "e9")], "src string, rel string, dst string")
    assert {r.id: r.hop for r in graph.frontier(v.filter("id = 'e1'"), e, 2).collect()} == {"e1": 0, "e2": 1, "e9": 1, "e3": 2}
    assert graph.dangling(e, v).count() == 1 and graph.with_endpoints(e, v).count() == 5
    assert {(r.rel, r.known) for r in graph.one_hop(v.filter("id in ('e1', 'e8')"), v, e).collect()} == {("r1", True), ("r6", False), (None, None)}
    seeds = spark.createDataFrame([("q", "a", 1.0)], "question string, id string, activation double")
    edges = spark.createDataFrame([("q", "a", "b", 1.0), ("q", "b", "c", 0.76), ("q", "c", "d", 1.0)], "question string, src string, dst string, weight double")
    # b reaches 1.0, c 0.6, and a, visited before, gains from b but stays at 1; d is beyond two hops
    assert {r.id: r.activation for r in graph.spreading_activation(seeds, edges).collect()} == {"a": 1.0, "b": 1.0, "c": 0.6}


def test_agent_and_evidence(spark):
    corpus = spark.createDataFrame([(1, "s1", 0, "a cat"), (1, "s2", 1, "a dog"), (1, "s3", 2, "cat two"), (2, "t1", 0, "x")], "question int, sid string, pos int, text string")
    seeds = spark.createDataFrame([(1, "s2"), (2, "t1")], "question int, sid string")
    script = spark.createDataFrame([(1, 1, "GREP: cat"), (1, 2, "FINAL: s3, s2, zz")], "question int, step int, command string")
    got = {(r.question, r.sid, r.origin) for r in agent.refine(seeds, corpus, script).collect()}
    assert got == {(1, "s3", "found"), (1, "s2", "seed"), (2, "t1", "seed")}
    ctx = spark.createDataFrame([("[sid=a:1][score=0.5] x [sid=b:2][score=0.25] [sid=a:1]",)], "c string")
    assert ctx.select(evidence.seed_sids(ctx.c)).first()[0] == ["a:1", "b:2"]
    assert [(x.sid, x.score) for x in ctx.select(evidence.seed_scores(ctx.c)).first()[0]] == [("a:1", "0.5"), ("b:2", "0.25")]


def test_provenance_and_models(spark):
    flat = spark.createDataFrame([("e", ["s1:m1", "s2:m2"], ["d1", "d2"])], "id string, ids array<string>, dates array<string>")
    got = prov.explode_events(prov.events_from_flat(flat, "ids", "dates"), "id").collect()
    assert [(r.ts, r.session_id, r.message_id, r.dialogue_datetime) for r in got] == [(0, "s1", "m1", "d1"), (1, "s2", "m2", "d2")]
    rows = spark.createDataFrame([("a", "b", 1, "x"), ("a", "b", 2, "xy"), ("a", "b", 3, "x")], "s string, t string, o int, d string")
    assert prov.merge_pairs(rows, ["s", "t"], "d", "o").first().d == "x; xy"
    texts = spark.createDataFrame([("a b",), (None,), ("ﬁn",)], "t string")
    assert [len(r.v) for r in texts.select(models.embedder()("t").alias("v")).collect()] == [64, 64, 64]
    assert texts.select(models.nfkc("t").alias("n")).collect()[2].n == "fin"


def test_exact_temporal_folds_compatibility_forms(spark):
    new = spark.createDataFrame([("a", "２０２３－０２", "Date"), ("b", "ﬁrst　of May ", "Time"), ("c", None, "Date"), ("d", "first of May", "Event")], "id string, name string, type string")
    known = spark.createDataFrame([("k1", "2023-02", "Date"), ("k2", "First  of may", "Time"), ("k3", None, "Date")], "id string, name string, type string")
    assert sorted(map(tuple, ingest.exact_temporal(new, known).collect())) == [("a", "k1"), ("b", "k2")]


def test_pins_scalars_and_raw_turns(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_text("alpha")
    digests = tables.file_digests(spark, str(tmp_path))
    tables.held_to_pins(digests, {"a.txt": hashlib.sha256(b"alpha").hexdigest().upper()})
    for pins in ({"a.txt": "00"}, {"b.txt": "00"}):
        with pytest.raises(ValueError, match="not as pinned"):
            tables.held_to_pins(digests, pins)
    good = spark.createDataFrame([('{"q": "x", "n": 5}',), ('{"q": "y", "n": 2.5}',)], "j string")
    assert [(r.q, r.n) for r in tables.scalars(good, "j", {"q": "q", "n": "n"}).collect()] == [("x", "5"), ("y", "2.5")]
    for bad in ('{"q": true}', '{"q": ["a"]}', '{"q": " "}', "{}", "no json", None):
        with pytest.raises(Exception, match="missing or no plain value"):
            tables.scalars(spark.createDataFrame([(bad,)], "j string"), "j", {"q": "q"}).collect()
    turns = spark.createDataFrame([("s", "1", 0), ("s", "x", 1), ("s", "1", 2), ("s", "2", 3), ("s", None, 4)], "session_id string, turn_index string, pos int")
    assert sorted((r.turn_index, r.pos) for r in tables.raw_turn_index(turns).collect()) == [(1, 0), (2, 3)]
    assert tables.benchmark_of(["﻿Question_ID", "question_type"]) == "haystack"
    for columns in (["x"], ["sample", "category_label", "question_id", "question_type"]):
        with pytest.raises(ValueError, match="cannot tell"):
            tables.benchmark_of(columns)
    qa = spark.createDataFrame([("a", None, None, "5"), ("b", None, None, "2")], "question string, answer string, evidence string, category string")
    assert [r.question for r in tables.without_adversarial(tables.normal_questions(qa)).collect()] == ["b"]


def test_manifests_see_changed_data(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, part string, v string")
    sinks.with_manifest(df, f"{tmp_path}/m", "part", "v1")
    assert sinks.is_complete(spark, f"{tmp_path}/m", "v1")
    df.withColumn("v", __import__("pyspark.sql.functions").sql.functions.lit("other")).write.mode("overwrite").partitionBy("part").parquet(f"{tmp_path}/m/data")
    assert not sinks.is_complete(spark, f"{tmp_path}/m", "v1")


def test_grep_reads_patterns_like_the_engine(spark):
    from colloquy.operators import turns as ops

    t = spark.createDataFrame([(1, "a (?P<n>x) b"), (2, "xx"), (3, "the (was] with")], "i int, text string")
    assert [r.i for r in ops.grep(t, "(?P<n>x)").collect()] == [1] and sorted(r.i for r in ops.grep(t, "X+").collect()) == [1, 2]
    assert [r.i for r in ops.grep(t, "the (was] with").collect()] == [3]
