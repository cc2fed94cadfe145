"""What a step passes on must not grow faster than its input: figures of the plan's nodes after a run."""

import random
from datetime import datetime

import pytest

from colloquy.operators import bm25, ingest, joins, knn, phrases


@pytest.fixture
def plain(spark):
    """Plans that stay as they are while they run, so that their nodes' figures can be read."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def figures(df, metric, named=""):
    """The rows of df, and a metric of all nodes of its plan that have it."""
    rows, out = df.collect(), []

    def walk(node):
        found = node.metrics().get(metric)
        if found.isDefined() and named in node.nodeName():
            out.append(found.get().value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return rows, out


def test_common_keys_of_a_lookup_do_not_multiply_rows(plain):
    asked = plain.range(300).selectExpr("id as k", "id % 7 as a", "0L as b")
    one = plain.sql("select * from values (1L, 50L), (1L, 40L), (2L, cast(null as long)) as t(a, v)")
    two = plain.range(400).selectExpr("0L as b", "id + 900 as v")
    rows, sizes = figures(joins.first_match(asked, "k", [(one, ["a"]), (two, ["b"])], "v"), "numOutputRows")
    assert {r.k: (r.v, r.step) for r in rows} == {k: (40, 1) if k % 7 == 1 else (None, 1) if k % 7 == 2 else (900, 2) for k in range(300)}
    assert max(sizes) < 1000


@pytest.mark.parametrize("form", ["spans", "rewritten", "augmented", "hints", "detected"])
def test_phrases_are_sought_once(spark, form):
    df = spark.createDataFrame([(1, "met last Monday, 3 weeks ago or in June 2024", datetime(2024, 7, 1))], "id int, text string, ref timestamp")
    found = getattr(phrases, form)(df, "id", "text", "ref")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # found, split off and, behind a bound, told apart
    assert all(plan.count(p) <= 3 for p in phrases.PATTERNS) and plan.count("Generate ") == 1
    assert found.count()


def test_phrases_in_texts_with_capitals_and_marks(spark):
    texts = {1: "LAST MONDAY İ; 3 Weeks AGO 😀 the Week After 2024-06-03", 2: "last MONTH" * 2 + " TODAY today", 3: "today, " * 500}
    df = spark.createDataFrame([(k, t, datetime(2024, 7, 3)) for k, t in texts.items()], "id int, text string, ref timestamp")
    got = {}
    for r in phrases.spans(df, "id", "text", "ref").orderBy("id", "n").collect():
        assert texts[r.id][r.start : r.stop] == r.text
        got.setdefault(r.id, []).append((r.text, r.display))
    assert got[1] == [("LAST MONDAY", "2024-07-01"), ("3 Weeks AGO", "2024-06-12"), ("the Week After 2024-06-03", "week of 2024-06-10")]
    assert got[2] == [("TODAY", "2024-07-03"), ("today", "2024-07-03")] and got[3] == [("today", "2024-07-03")] * 500


def test_shared_words_against_all_pairs(plain):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(14)]
    pick = lambda: rng.sample(words, rng.choice([0, 1, 2, 3, 3, 9, 11]))
    new, known = {i: pick() for i in range(60)}, {i: pick() for i in range(200)}
    a = plain.createDataFrame(list(new.items()), "id int, w array<string>")
    b = plain.createDataFrame(list(known.items()), "candidate int, w array<string>")
    want = set()
    for i, w in new.items():
        shared = sorted((-len({*w} & {*v}), c) for c, v in known.items() if {*w} & {*v})
        want |= {(i, c, float(-n)) for n, c in shared[:3]}
    assert {tuple(r) for r in ingest.most_shared(a, b, "w", 3).collect()} == want


def test_common_words_do_not_multiply_candidates(plain):
    a = plain.range(500).selectExpr("id", "array('old', 'plate', concat('x', id % 2)) as w")
    b = plain.range(500).selectExpr("id as candidate", "array('plate', 'old', concat('y', id % 2)) as w")
    rows, sizes = figures(ingest.most_shared(a, b, "w", 3), "numOutputRows")
    assert sorted(map(tuple, rows)) == [(i, c, 2.0) for i in range(500) for c in range(3)]
    assert max(sizes) <= 2000


def test_equal_vectors_of_many_queries(spark):
    rng = random.Random(4)
    vectors = [[float(rng.randint(0, 2)) for _ in range(3)] for _ in range(12)] + [None, [0.0, 0.0, 0.0]]
    rows = [(i, vectors[rng.randrange(14)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for skip_self in (True, False):
        whole = knn.top_k(df, df, 4, skip_self=skip_self, threshold=0.5).collect()
        for block in (4, 100):
            many = knn.top_k(df, df, 4, skip_self=skip_self, threshold=0.5, block=block).collect()
            assert sorted(map(tuple, many)) == sorted(map(tuple, whole)) and many


def test_scores_of_many_queries_are_summed_in_place(plain, tmp_path, monkeypatch):
    plain.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plain.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(5)
    df = plain.createDataFrame([(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", f"word{chr(97 + i % 7)}"]) for _ in range(6))) for i in range(120)], "id long, text string")
    index, asked = bm25.build(df, "id", "text"), df.withColumnRenamed("id", "q")
    want = sorted(map(tuple, index.scores(asked, "q", "text").collect()))
    monkeypatch.setattr(bm25, "FEW_TERMS", 0)
    for sums, sent in ((3_000_000, 200_000), (500, 100)):
        monkeypatch.setattr(bm25, "SUMS", sums)
        monkeypatch.setattr(bm25, "SENT_TERMS", sent)
        found = index.scores(asked, "q", "text")
        assert sorted(map(tuple, found.collect())) == want and want
        rows, moved = figures(bm25.top(found, "q", "id", 2), "shuffleRecordsWritten")
        assert len(rows) == 240 and max(moved) < len(want) / 2
    plain.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_best_of_many_queries_make_no_pairs(plain, tmp_path, monkeypatch):
    plain.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plain.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    texts = [" ".join(rng.choice([*words, f"word{chr(97 + i % 7)}"]) for _ in range(6)) for i in range(200)]
    # copies, keys that several documents have, no key, no text, and a word in half of the documents and one in more, whose weights are 0 and less than others
    rows = [(i // 2 if i > 190 else i, t + " half" * (i % 2) + " most" * (i % 3 > 0)) for i, t in enumerate([*texts, *texts[:40]])] + [(None, "alpha beta"), (500, None), (501, "half"), (502, "")]
    df = plain.createDataFrame(rows, "id long, text string")
    index, asked = bm25.build(df, "id", "text"), df.filter("id is null or id % 2 = 0 or id > 498").withColumnRenamed("id", "q")
    for k in (3, 90):
        monkeypatch.setattr(bm25, "FEW_TERMS", 10_000)
        want = sorted(map(tuple, bm25.top(index.scores(asked, "q", "text"), "q", "id", k).collect()), key=str)
        monkeypatch.setattr(bm25, "FEW_TERMS", 0)
        for held in (3_000_000, 150):
            monkeypatch.setattr(bm25, "HELD_POSTINGS", held)
            monkeypatch.setattr(bm25, "HELD_ASKED", held)
            found = index.best(asked, "q", "text", k)
            assert sorted(map(tuple, found.collect()), key=str) == want and want
    pairs = index.scores(asked, "q", "text").count()
    monkeypatch.setattr(bm25, "HELD_POSTINGS", 3_000_000)
    monkeypatch.setattr(bm25, "HELD_ASKED", 2_000_000)
    _, sizes = figures(index.best(asked, "q", "text", 1), "numOutputRows")
    assert max(sizes) < pairs
    plain.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("form", ["detected", "spans", "hints", "rewritten", "augmented"])
def test_equal_texts_are_worked_out_once(plain, form):
    texts, refs = ["met LAST Monday \ue000 or today", "in 3 Hours", "nothing", None], [datetime(2024, 7, 1, 8, 30), datetime(2024, 7, 1, 21), datetime(2024, 7, 2, 8, 30)]
    rows = [(i, texts[i % 4], refs[i % 3]) for i in range(600)] + [(601, "today", None)]
    df = plain.createDataFrame(rows, "id int, text string, ref timestamp")
    found, sizes = figures(getattr(phrases, form)(df, "id", "text", "ref"), "numOutputRows", "Generate")
    assert sizes and max(sizes) <= 12
    by = {}
    for r in found:
        by.setdefault(r.id, []).append(str(tuple(r)[1:]))
    said = {i for i in by if i < 600}
    assert all(sorted(by[i]) == sorted(by[i % 12]) for i in said) and len(said) == (600 if form not in ("spans", "hints") else 300)
    # hours go by the time, days by the day
    assert "2024-07-02" in by[1][0] and "2024-07-01" in by[9][0] and "2024-06-24" in "".join(by[0]) + "".join(by[4])
