"""How often, and by how many rows, what is stored is read and moved."""

from pyspark.sql import functions as F

from colloquy import settings
from colloquy.operators import bm25, bm25_store, contexts, probes, vector_index
from colloquy.plans import probing, retrieval
from colloquy.sources import store
from test_growth import figures, plain  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_only_postings_of_asked_terms_meet_the_keys_that_are_gone(plain, tmp_path, monkeypatch):  # noqa: F811
    plain.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(bm25_store, "SENT_KEYS", 0)
    words = [f"word{a}{b}" for a in "abcdefghij" for b in "abcdefghij"]
    docs = plain.createDataFrame([(i, " ".join(words) + (" rare" if i % 20 == 0 else "")) for i in range(60)], "id long, body string")
    book = bm25_store.Stored(plain, store.shared_dir(plain, "live"), "id")
    for part in (docs, docs.filter("id < 40"), docs.filter("id >= 55").withColumn("body", F.lit("rare rare"))):
        book.put(part, "body")
    book.remove(docs.filter("id = 20"))
    found = book.index().scores(plain.createDataFrame([(1, "rare")], "q long, text string"), "q", "text")
    rows, moved = figures(found, "shuffleRecordsWritten")
    assert {r.id for r in rows} == {0, 40, *range(55, 60)}
    assert max(moved) < 200
    plain.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_new_keys_do_not_read_older_postings(spark):
    docs = spark.range(20).select("id", F.lit("some words").alias("body"))
    path = store.shared_dir(spark, "live")
    book = bm25_store.Stored(spark, path, "id")
    book.put(docs, "body")
    # postings of the first generation that cannot be read
    files = store.Files(spark)
    files.rename(f"{path}/postings/gen=0", f"{path}/away")
    book.put(docs.select((F.col("id") + 100).alias("id"), "body"), "body")
    files.rename(f"{path}/away", f"{path}/postings/gen=0")
    index = book.index()
    assert (index.n, index.avgdl, sorted((r.term, r.df) for r in index.df.collect())) == (40, 2.0, [("some", 40), ("words", 40)])


def test_frequencies_are_stored_once(spark):
    index = bm25.build(spark.createDataFrame([(1, "aword bword aword"), (2, None), (3, "bword")], "id long, body string"), "id", "body")
    assert index.df.inputFiles() and sorted(map(tuple, index.df.collect())) == [("aword", 1), ("bword", 2)]
    assert (index.n, round(index.avgdl, 9)) == (3, round(4 / 3, 9))


def test_ranks_that_are_read_twice_are_stored(spark):
    assert not any("postings-" in f for f in retrieval.topk_sweep(spark, SF).inputFiles())


def test_logs_of_probes_are_read_once_and_moved_once(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    two, three = "case int, id string", "case int, sid string, id string"
    turns, ids = [(i, "s") for i in range(6)], [(i, "s", x) for i in range(6) for x in ("a", "b")] + [(4, "s", None)]
    seen = [(i, x) for i in range(5) for x in ("a", "b", None)]
    judged = [(0, "a", None, True), (1, "a", False, None), (2, "a", True, True), (3, None, False, False)]
    found = probes.first_failing(df([(i,) for i in range(6)], "case int"), df([(i,) for i in range(6)], "case int"), df(turns, "case int, sid string"), df(turns, "case int, sid string"), df(ids, three), df(seen, two),
        df(judged, "case int, id string, above boolean, within boolean"), df([(0, "b"), (2, "c"), (3, "b"), (4, None)], two), df([(1, "a"), (1, "b")], two))
    assert {r.case: r.step for r in found.collect()} == {0: "answer", 1: "filter", 2: "evidence", 3: "answer", 4: "evidence", 5: "pool"}
    plan = probing.case_probes(spark, SF)
    assert not any("lineitem" in f for f in plan.inputFiles())
    # one grouping of all logs by case and id
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [case#") <= 8


def test_vectors_of_an_index_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embed(i):
        made.add(1)
        return [float(i % 7 + 1), float(i % 5)]

    corpus = store.written(spark.range(300).select(F.col("id").alias("vec_id"), embed("id").alias("embedding")), "letters")
    index = vector_index.build(corpus, store.shared_dir(spark, "index"))
    assert made.value == 300 and index.size.sum() == 300
    # a text is lowered once, not for each letter
    seen = spark.createDataFrame([("Aab z",), ("",), (None,)], "t string").select(retrieval.letters(F.col("t")).alias("v"))
    assert "lambda" not in seen._jdf.queryExecution().optimizedPlan().toString()
    got = [r.v for r in seen.collect()]
    assert (got[0][:2], got[0][25], sum(got[0])) == ([2.0, 1.0], 1.0, 4.0) and got[1:] == [[0.0] * 26, [None] * 26]


def test_relations_of_one_label_are_not_all_compared(spark, monkeypatch):
    none, seen = F.lit(None).cast("string"), []
    relations = spark.range(400).select("id", (F.col("id") + 1).alias("src"), (F.col("id") + 2).alias("dst"), F.concat(F.lit("car "), F.col("id") % 2).alias("label"), F.lit(1.0).alias("weight")).withColumn("embedding", retrieval.letters(F.col("label")))
    kb = contexts.Knowledge(spark.range(0).select("id", none.alias("name")), None, relations, spark.range(0), spark.range(0))
    plan = contexts.Plan(settings.Search(relation_topk=3))
    asked = spark.createDataFrame([(1, "car")], "question long, text string")
    chosen = spark.range(402).select(F.lit(1).cast("long").alias("question"), "id")
    top_k = contexts.knn.top_k
    monkeypatch.setattr(contexts.knn, "top_k", lambda q, corpus, *a, **k: seen.append(corpus.count()) or top_k(q, corpus, *a, **k))
    assert sorted(r.id for r in contexts.related(asked, chosen, kb, plan, retrieval.letters).collect()) == [0, 1, 2]
    assert seen == [6]
