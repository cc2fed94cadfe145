import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import knn, vector_index
from colloquy.sources import store

SCHEMA = "vec_id long, embedding array<double>"


def brute(queries, corpus, k, skip_self=True):
    def unit(v):
        ok = v and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v) and any(v)
        return np.array(v) / np.sqrt((np.array(v) ** 2).sum()) if ok else None

    out = []
    for q, v in queries:
        if unit(v) is None or q is None:
            continue
        s = sorted((-round(float(unit(v) @ unit(x)), 6), i) for i, x in corpus if i is not None and unit(x) is not None and not (skip_self and i == q))[:k]
        out += [(q, i, -c + 0.0, n + 1) for n, (c, i) in enumerate(s)]
    return sorted(out)


def rows(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(7, 6))[rng.integers(0, 7, n)] + 0.2 * rng.normal(size=(n, 6))
    x[n // 2 : n // 2 + n // 5] = x[0]
    return [(i, x[i].tolist()) for i in range(n)]


def got(df):
    return sorted((r.qid, r.id, r.score, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("block,asked,sample", [(4096, 8192, 20_000), (30, 9, 150)])
def test_against_brute_force(spark, monkeypatch, block, asked, sample):
    for name, v in (("BLOCK", block), ("ASKED", asked), ("SAMPLE", sample), ("SLICE", 16 if block == 30 else 512)):
        monkeypatch.setattr(vector_index, name, v)
    corpus = rows(400, 3) + [(900, None), (901, []), (902, [0.0] * 6), (903, [1.0, None] + [0.0] * 4), (904, [float("nan")] * 6), (905, [1.0, 2.0]), (None, [1.0] * 6)]
    queries = [r for r in corpus if r[0] is None or r[0] % 9 == 0 or r[0] >= 900] + [(-5, [1.0] * 6)]
    c, q = spark.createDataFrame(corpus, SCHEMA), spark.createDataFrame(queries, SCHEMA)
    path = store.shared_dir(spark, "index")
    index = vector_index.build(c, path)
    for k in (1, 7):
        assert got(index.search(q, k)) == brute(queries, corpus, k)
    assert got(vector_index.opened(spark, path).search(q, 500, skip_self=False)) == brute(queries, corpus, 500, False)
    above = [r for r in brute(queries, corpus, 7) if r[2] >= 0.9]
    assert got(index.search(q, 7, threshold=0.9)) == above
    assert index.search(q.limit(0), 3).count() == 0


def test_no_rows(spark):
    c = spark.createDataFrame([(1, None), (2, [])], SCHEMA)
    q = spark.createDataFrame([(1, [1.0])], SCHEMA)
    assert vector_index.top_k(q, c, 3).count() == 0
    assert vector_index.top_k(q, spark.createDataFrame([(1, [0.0])], SCHEMA), 3).count() == 0


def test_bounds_hold_and_spare_cells():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 16)).repeat(100, 0) + 0.1 * rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = vector_index.centres(x, 20)
    s = x @ c.T
    cell = s.argmax(1)
    bound = vector_index.best(x[::50], c, np.array([s[cell == i, i].min(initial=1.0) for i in range(20)]), np.bincount(cell, minlength=20))
    cos = x[::50] @ x.T
    assert (cos <= bound[:, cell]).all()
    tenth = np.sort(cos, 1)[:, -10]
    assert (bound < tenth[:, None]).mean() > 0.5  # cells that a search for ten does not read


def test_many_queries_of_the_plain_search_go_through_the_index(spark):
    c = spark.createDataFrame(rows(200, 6), SCHEMA)
    q = c.filter("vec_id % 3 = 0")
    assert got(knn.top_k(q, c, 4, block=20)) == got(knn.top_k(q, c, 4))


def test_each_keyword_is_searched(spark):
    corpus = spark.createDataFrame([(i, [float(w.count(c)) for c in "abcdef"]) for i, w in enumerate(["abc", "aab", "def", "fff", "abc"])], SCHEMA)
    index = vector_index.build(corpus, store.shared_dir(spark, "index"))
    asked = spark.createDataFrame([(1, ["abc", "fed", "abc", "", None]), (2, ["abc"]), (3, None), (4, ["zzz"])], "q int, words array<string>")
    letters = lambda text: F.transform(F.array(*(F.lit(c) for c in "abcdef")), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    hits = vector_index.by_keyword(asked, index, "q", "words", letters, 2, 0.9).collect()
    assert sorted((r.q, r.keyword, r.id, r["rank"]) for r in hits) == [(1, "abc", 0, 1), (1, "abc", 4, 2), (1, "fed", 2, 1), (2, "abc", 0, 1), (2, "abc", 4, 2)]
