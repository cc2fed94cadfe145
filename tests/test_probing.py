import os
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators import pointwise, probes, reach, resumable


def test_a_case_for_each_step(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    every = list(range(1, 11))
    pairs = lambda ids: [(i, f"e{i}") for i in ids]
    filtered = [(i, f"e{i}", i not in (6, 8), i not in (7, 8)) for i in (6, 7, 8, 9)]
    got = {r.case: (r.step, r.cause) for r in probes.first_failing(
        df([(i,) for i in every] + [(1,)], "case int"), df([(i,) for i in every[1:]], "case int"), df([(i, "s") for i in every if i != 2], "case int, sid string"), df([(i, "s") for i in every if i != 3], "case int, sid string"),
        df([(i, "s", f"e{i}") for i in every if i != 4] + [(4, "other", "e4")], "case int, sid string, id string"), df(pairs([i for i in every if i != 5]) + [(5, "e6")], "case int, id string"),
        df(filtered, "case int, id string, above boolean, within boolean"), df(pairs([1, 6, 10]), "case int, id string"), df(pairs([7]), "case int, id string"),
    ).collect()}
    steps = ["ingest", "gold", "summary", "extraction", "pool", "filter", "filter", "filter", "evidence", "answer"]
    assert [got[i][0] for i in every] == steps
    assert [got[i][1] for i in (6, 7, 8)] == ["cut by threshold and not recovered", "cut by top-k and recovered in part", "cut by threshold and top-k and not recovered"]


def test_whole_words_by_equality(spark):
    texts = ["Re-read the book's cover", "don't re-", "x-1 'tis rock-'n'-roll", "a--b", "naïve café", "", None, "READ"]
    every = {w for t in texts if t for w in re.findall("[A-Za-z0-9][A-Za-z0-9'-]*", t.lower())} | {"read", "re", "s", "book", "n", "roll", "'n", "b", "ve"}
    found = [set(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(reach.findable(F.col("t"))).collect()]
    for t, got in zip(texts, found, strict=True):
        want = {w for w in every if w[0].isalnum() and re.search(rf"(?<![A-Za-z0-9]){re.escape(w)}(?![A-Za-z0-9'-])", (t or "").lower())}
        assert got & every == want


def test_reach_by_pairs_and_answers(spark):
    q = spark.createDataFrame([(1, 10, "the blue car of Ann", "a Volvo, blue"), (2, 10, None, None)], "question int, haystack int, text string, answer string")
    t = spark.createDataFrame([(10, 0, "Ann's blue car", True), (10, 1, "a volvo", True), (10, 2, "blue", True), (10, 3, "blue blue", False), (10, 4, "nothing", True), (11, 0, "blue car", True)], "haystack int, turn int, text string, gold boolean")
    got = {(r.question, r.turn): (r["any"], r.useful, r.pair, r.answer) for r in reach.reached(q, t, 1, ["the", "of"]).collect()}
    no = (False,) * 4
    assert got == {(1, 0): (True, True, True, False), (1, 1): (False, False, False, True), (1, 2): (True, False, False, False), (1, 4): no, (2, 0): no, (2, 1): no, (2, 2): no, (2, 4): no}
    whole = {r.question: (r.n_gold, r["any"], r.pair, r.answer, r.all_any) for r in reach.summary(reach.reached(q, t, 1, [])).collect()}
    assert whole[1] == (4, 2, 1, 1, False)


def test_scores_of_recorded_answers(spark):
    rows = [([("yes", -0.1), ("no", -2.0)], "no"), ([("▁Yes", -0.5), ("YES", -0.1)], None), ([(" No ", -0.25)], None), ([("maybe", -0.1)], "yes"), ([], "Yes!"), (None, " yes"), (None, "no"), (None, None)]
    df = spark.createDataFrame(rows, "top array<struct<token: string, logprob: double>>, text string")
    got = [round(r[0], 6) for r in df.select(pointwise.score(F.col("top"), F.col("text"))).collect()]
    assert got == [1.9, 99.5, -99.75, 0.0, 1.0, 1.0, -1.0, -1.0]
    ask = {"entity": "E?", "evidence": "V?"}
    pairs = spark.createDataFrame([(1, "q", "entity", i, t) for i, t in enumerate(["a", "b", "a", "zz"])] + [(1, "q", "evidence", 9, "a"), (1, "q", "unknown", 8, "a")], "question int, question_text string, kind string, id int, text string")
    known = pairs.filter("text <> 'zz'").select(F.sha2(pointwise.prompt(ask, F.col("kind"), F.col("question_text"), F.col("text")), 256).alias("key"), F.lit(None).cast("array<struct<token: string, logprob: double>>").alias("top"), F.when(F.col("kind") == "evidence", "no").otherwise(F.when(F.col("text") == "b", "yes")).alias("text"))
    out = [(r.kind, r.id, r.score) for r in pointwise.reranked(pairs, known, ask).orderBy("kind", "rank").collect()]
    assert out == [("entity", 1, 1.0), ("entity", 0, -1.0), ("entity", 2, -1.0), ("entity", 3, None), ("evidence", 9, -1.0), ("unknown", 8, None)]
    assert pointwise.reranked(pairs, known, ask, threshold=0.0).count() == 1


def test_a_stopped_job_goes_on(spark, tmp_path):
    """The judge fails at one row until a file is there; portions that were committed before are not judged again."""
    path, flag = f"{tmp_path}/verdicts", f"{tmp_path}/mended"
    rows = spark.createDataFrame([(i, "q", "a", None) for i in range(12)] + [(100, " ", "a", None), (101, "q", None, 0.0), (102, "q", "a", 1.0), (103, "q", "a", 0.5)], "id long, question string, answer string, verdict double")

    def with_stamp(stamp):
        def one(i):
            if i == 7 and not os.path.exists(flag):
                raise ValueError("the judge is away")
            return float(stamp)

        return lambda part: part.withColumn("verdict", F.udf(one, T.DoubleType())("id"))

    portion = F.pmod("id", F.lit(4))
    with pytest.raises(PySparkException):
        resumable.judge(rows, path, "id", with_stamp(10), portion=portion)
    before = {r.id: r.verdict for r in resumable.verdicts(spark, path, "id").collect()}
    assert before == {i: 10.0 for i in (0, 1, 2, 4, 5, 6, 8, 9, 10)}
    open(flag, "w").close()
    got = {r.id: r.verdict for r in resumable.judge(rows, path, "id", with_stamp(20), portion=portion).collect()}
    want = {i: 20.0 if i % 4 == 3 else 10.0 for i in range(12)} | {100: None, 101: 0.0, 102: 1.0, 103: 20.0}
    assert got == want
    more = rows.union(spark.createDataFrame([(200, "q", "a", None)], rows.schema))
    again = {r.id: r.verdict for r in resumable.judge(more, path, "id", with_stamp(30), portion=portion).collect()}
    assert again == want | {200: 30.0}
