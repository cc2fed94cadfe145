import random

from pyspark.sql import functions as F

from colloquy.operators import bm25, bm25_store
from colloquy.sources import store

WORDS = [f"{c}{d}word" for c in "abcdefgh" for d in "xyz"]
DOC = "id long, body string"


def table(index, queries):
    return sorted((r.q, r.id, r.score) for r in index.scores(queries, "q", "text").collect())


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_changes_equal_a_rebuild(spark):
    rng = random.Random(5)
    queries = spark.createDataFrame([(i, text(rng, 3)) for i in range(6)], "q long, text string")
    book = bm25_store.Stored(spark, store.shared_dir(spark, "live"), "id")
    assert book.generation() == -1
    now: dict[int, str | None] = {}
    steps = [
        {i: text(rng, rng.randint(0, 30)) for i in range(40)},
        {i: text(rng, rng.randint(0, 30)) for i in range(30, 60)} | {70: None, 71: ""},  # some anew, with other texts
        [3, 4, 5, 999],
        {4: "axword axword", 30: text(rng, 5)},
        {},
    ]
    for step in steps:
        if isinstance(step, dict):
            now |= step
            book.put(spark.createDataFrame([*step.items(), (None, "axword")], DOC), "body")
        else:
            now = {k: v for k, v in now.items() if k not in step}
            book.remove(spark.createDataFrame([(k,) for k in step], "id long"))
        fresh = bm25.build(spark.createDataFrame(list(now.items()), DOC), "id", "body")
        index = book.index()
        assert (index.n, round(index.avgdl, 9), round(index.mean, 9)) == (fresh.n, round(fresh.avgdl, 9), round(fresh.mean, 9))
        assert table(index, queries) == table(fresh, queries)
    whole = book.merged(store.shared_dir(spark, "merged"))
    assert table(whole.index(), queries) == table(book.index(), queries) and whole.live().count() == book.live().count()


def test_a_change_that_was_cut_short_does_not_count(spark):
    rng = random.Random(6)
    queries = spark.createDataFrame([(1, "axword byword")], "q long, text string")
    path = store.shared_dir(spark, "live")
    book = bm25_store.Stored(spark, path, "id")
    book.put(spark.createDataFrame([(i, text(rng, 9)) for i in range(9)], DOC), "body")
    before = table(book.index(), queries)
    # the next generation got as far as its postings
    book._write(bm25._posted(spark.createDataFrame([(1, "axword")], DOC), "id", ["body"], book.split, True), "postings", 1)
    assert table(book.index(), queries) == before and book.generation() == 0
    book.put(spark.createDataFrame([(50, "axword byword")], DOC), "body")
    assert {i for _, i, _ in table(book.index(), queries)} == {i for _, i, _ in before} | {50}


def test_counts_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "bword aword bword bword"), (2, None), (3, "the of"), (4, "cword")], DOC)
    posted = bm25.postings(docs, "id", "body")
    assert sorted((r.id, r.term, r.tf, r.dl) for r in posted.collect()) == [(1, "aword", 1, 4), (1, "bword", 3, 4), (4, "cword", 1, 1)]
    assert "Exchange hashpartitioning" not in posted._jdf.queryExecution().toString()
    both = bm25.build_fields(docs.withColumn("other", F.reverse("body")), "id", ["body", "other"])
    assert both["body"].n == both["other"].n == 4 and both["other"].posted.filter("term = 'drowc'").count() == 1
