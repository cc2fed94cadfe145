"""Values of operators that SQL cannot express, against plain loops and recorded rows."""

import json
import random

from colloquy.functions import models, parsing
from colloquy.operators import diagnosis, evidence, graph, ingest, joins, phrases, provenance
from colloquy.sources import cache, sinks, tables


def test_sentence_chunks():
    text = "One two. Three four five! " + "x" * 30 + " six? Seven."
    got = parsing.sentence_chunks(text, 30)
    assert got == ["One two. Three four five!", "x" * 30, "six? Seven."]
    assert parsing.sentence_chunks("a. " * 20, 20) == ["a. a. a. a. a. a."] * 3 + ["a. a."] and parsing.sentence_chunks(None, 5) == [] and parsing.sentence_chunks("  ", 5) == []
    rng = random.Random(1)
    for _ in range(50):
        words = "".join(rng.choice(["ab", "c", ". ", "! ", " "]) for _ in range(200))
        pieces = parsing.sentence_chunks(words, 40)
        assert all(0 < len(p) <= 40 for p in pieces) and "".join("".join(pieces).split()) == "".join(words.split())


def test_spreading_activation_against_a_plain_queue(spark):
    rng = random.Random(3)
    rows, seeds, want = [], [], set()
    for q in range(6):
        edges = {(f"v{a}", f"v{b}"): round(rng.random(), 3) for a in range(8) for b in range(8) if a < b and rng.random() < 0.4}
        start = {f"v{i}": round(0.5 + i / 10, 2) for i in rng.sample(range(8), 2)}
        rows += [(q, a, b, w) for (a, b), w in edges.items()]
        seeds += [(q, i, a) for i, a in start.items()]
        near: dict = {}
        for (a, b), w in edges.items():
            if (w - 0.4) / 0.6 > 0:
                near.setdefault(a, []).append((b, (w - 0.4) / 0.6))
                near.setdefault(b, []).append((a, (w - 0.4) / 0.6))
        act, depth, queue = dict(start), dict.fromkeys(start, 0), sorted(start)
        while queue:
            node = queue.pop(0)
            if depth[node] == 2:
                continue
            for other, w in sorted(near.get(node, [])):
                act[other] = min(1.0, act.get(other, 0) + w * act[node])
                if other not in depth:
                    depth[other] = depth[node] + 1
                    queue.append(other)
        want |= {(q, k, round(v, 6)) for k, v in act.items() if k in start or v >= 0.5}
    got = graph.spreading_activation(spark.createDataFrame(seeds, "question int, id string, activation double"), spark.createDataFrame(rows, "question int, src string, dst string, weight double"))
    assert set(map(tuple, got.collect())) == want


def test_lenient_records_of_broken_text(spark):
    cases = [
        (1, "entity|Ann|person|a friend##entity|Rome\n(\"entity\"<|>Bob<|>alien<|>odd)<|COMPLETE|>"), (2, "relationship|Ann|Rome|lives in\nrelationship|Ann"), (3, ""), (4, None), (5, "just prose without marks"), (6, "Ann\tperson\tno kind given"), (7, "|||"),
    ]
    got = [tuple(r) for r in ingest.lenient_records(spark.createDataFrame(cases, "k int, t string"), "k", "t").orderBy("k", "n").collect()]
    assert got == [(1, 0, "entity", "Ann", "Person", "a friend"), (1, 1, "entity", "Bob", "Concept", "odd"), (2, 0, "relationship", "Ann", "Rome", "lives in"), (6, 0, "entity", "Ann", "Person", "no kind given")]


def test_strict_records_of_broken_text(spark):
    cases = [(1, '("entity"<|>Ann<|>PERSON<|>said "hi")##("entity"<|><|>person<|>nameless)##("thing"<|>x<|>y)##("relationship"<|>Ann<|>Ann<|>self)'), (2, '("entity"<|>Bob'), (3, None), (4, "<|COMPLETE|>(\"entity\"<|>late<|>person<|>x)"), (5, '("relationship"<|>a<|>b<|>no ends)')]
    rec = ingest.strict_records(spark.createDataFrame(cases, "k int, t string"), "k", "t")
    assert [(r.k, r["name"], r.type) for r in ingest.entities(rec, "k").orderBy("k", "n").collect()] == [(1, "Ann", "Person"), (2, "Bob", "Concept")]
    assert [(r.k, r.source, r.target) for r in ingest.relations(rec, "k").collect()] == [(1, "Ann", "Ann")]


def test_hints_and_rewritten_columns(spark):
    rows = [(1, "met last Tuesday and Last  Tuesday", "2023-03-09 15:47:00"), (2, None, "2023-03-09 15:47:00"), (3, "yesterday", None), (4, "before July 4, 2023 at 13 am", "2023-03-09 15:47:00")]
    df = spark.createDataFrame(rows, "k int, t string, r string").selectExpr("k", "t", "cast(r as timestamp) as r")
    assert sorted(map(tuple, phrases.hints(df, "k", "t", "r").collect())) == [(1, "last  tuesday", "2023-03-07"), (1, "last tuesday", "2023-03-07"), (4, "before july 4, 2023", "before 2023-07-04")]
    got = {r.k: (r.question, r.augmented) for r in phrases.augmented(phrases.rewritten(df, "k", "t", "r"), "k", "t", "r").collect()}
    assert got[1][0] == "met on 2023-03-07 and on 2023-03-07" and got[2] == (None, None) and got[3] == ("yesterday", "yesterday")
    assert got[4][1] == "before July 4, 2023 [DATE: before 2023-07-04] at 13 am"
    one = spark.createDataFrame([(1, "from last week until 2023-02-30", "2023-03-09")], "k int, t string, r string").selectExpr("k", "t", "cast(r as timestamp) as r")
    found = phrases.detected(one, "k", "t", "r").first()
    assert found.has_time and [tuple(e) for e in found.expressions] == [("last week", "2023-02-27", "2023-03-05", "week")]


def test_operators_used_by_no_query(spark):
    new = spark.createDataFrame([("a",), ("b",)], "id string")
    lex = spark.createDataFrame([("a", "x"), ("a", "x"), ("z", "q")], "id string, candidate string")
    dense = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "w")], "id string, candidate string")
    assert sorted(map(tuple, ingest.similar_candidates(new, lex, dense).collect())) == [("a", "x", "lexical"), ("a", "y", "dense"), ("b", "w", "dense")]
    prov = spark.createDataFrame([("e", [(0, "s1", "s", "m", "d"), (1, "s9", "s", "m", "d")])], f"id string, prov array<{provenance.EVENT}>")
    assert [r.text for r in provenance.expand_to_summaries(prov, spark.createDataFrame([("s1", "one")], "summary_id string, text string"), "id").collect()] == ["one"]
    ctx = evidence.append_fetched(spark.createDataFrame([(1, "c"), (2, "d")], "q int, context string"), spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "q int, n int, line string"), "q")
    assert {r.q: r.context for r in ctx.collect()} == {1: "c\n=== Additional Evidence ===\na\nb", 2: "d"}
    df = spark.createDataFrame([(True, False, '["x", "y", "x"]', "[sid=q]"), (True, True, None, "[sid=q] [sid=q]")], "a boolean, b boolean, ids string, context string")
    got = df.select(diagnosis.first_failing_step({"seed": df.a, "rank": df.b}).alias("s"), parsing.retrieved_ids(df.ids, df.context).alias("r")).collect()
    assert [(x.s, x.r) for x in got] == [("rank", ["x", "y"]), ("ok", ["q"])]
    q = spark.createDataFrame([("p1",), ("p2",)], "prompt string")
    known = spark.createDataFrame([("p1", ["k"], "ans")], "p string, keywords array<string>, answer string").selectExpr("sha2(p, 256) as key", "keywords", "answer")
    assert {r.prompt: r.keywords for r in tables.cached_keywords(q, known, "prompt").collect()} == {"p1": ["k"], "p2": []}
    assert {r.prompt: r.answer for r in models.replayed(q, known, "prompt").collect()} == {"p1": "ans", "p2": None}
    rank = models.reranker(lambda: lambda qs, ts, ks: [float(len(t)) for t in ts])
    pair = spark.createDataFrame([("a b", "abc", "k")], "q string, t string, k string")
    assert pair.select(rank("q", "t", "k").alias("s"), models.compressed(pair.q, 1).alias("c")).first() == (3.0, "a")
    assert [r.k for r in joins.needs_rerun(spark.createDataFrame([(1, None, "x"), (2, True, "x"), (3, False, " "), (4, False, None)], "k int, f boolean, c string"), __import__("pyspark.sql.functions").sql.functions.col("f"), "c").orderBy("k").collect()] == [2, 3, 4]


def test_caches_and_reports(spark, tmp_path):
    schema = "id string, name string"
    path = str(tmp_path / "cache")
    assert cache.load(spark, path, schema).count() == 0
    cache.save(spark.createDataFrame([("a", "x")], schema), path)
    assert [tuple(r) for r in cache.load(spark, path, schema).collect()] == [("a", "x")]
    (next((tmp_path / "cache").glob("*.parquet"))).write_bytes(b"broken")
    assert cache.load(spark, path, schema).count() == 0
    cache.clear(spark, path)
    assert not (tmp_path / "cache").exists()
    stages = spark.createDataFrame([("r1", 2, "rank", "e1;e2", None), ("r1", 1, "seed", "e1;e2;e3", None), ("r1", 3, "expand", None, "off"), ("r2", 1, "seed", "z", None)], "request string, seq int, stage string, names string, skipped string")
    got = {r.request: r.trace for r in sinks.traces(stages, "request", "seq", "stage", "names", "skipped").collect()}
    assert got["r1"] == "1. seed: e1;e2;e3\n2. rank: e1;e2\n3. expand: skipped (off)" and got["r2"] == "1. seed: z"
    sinks.write_evaluation(spark.createDataFrame([], "q string, score double"), f"{tmp_path}/e")
    assert spark.read.option("header", True).csv(f"{tmp_path}/e").columns == ["q", "score"]
    sinks.export_traces(stages, f"{tmp_path}/t", "request", "seq", "stage", "names", "skipped")
    lines = [json.loads(x) for f in (tmp_path / "t").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(x["request"] for x in lines) == ["r1", "r2"] and max(len(x["stages"]) for x in lines) == 3
