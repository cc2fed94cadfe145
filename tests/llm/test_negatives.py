import math

import duckdb
import numpy as np
import pytest

from colloquy.llm import negatives, vptree


def brute(rows, every=100, positives=5, negatives=5, share=80):
    use = {(i, lab, tuple(math.floor(256 * c) for c in v)) for i, lab, v in rows if i is not None and lab is not None and v and len(v) == 6 and all(c is not None and math.isfinite(c) and abs(c) < 2**18 for c in v)}
    out = []
    for i, lab, q in use:
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, x, strict=True)), j, other) for j, other, x in use if j != i))
        for ps, p, _ in [s for s in scored if s[2] == lab][:positives]:
            fit = [s for s in scored if s[2] != lab and share * -ps <= 100 * -s[0] <= 100 * -ps][:negatives]
            out += [(i, p, n + 1, j, -ps, -s) for n, (s, j, _) in enumerate(fit)]
    return sorted(out)


def got(df, **kw):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in negatives.mine(df, **kw).collect())


def sample(n, seed):
    """Clusters that hold several labels, copies of one vector, and vectors of very unlike lengths."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 6))
    x = centres[rng.integers(0, 9, n)] * rng.choice([0.05, 1, 4], n)[:, None] + 0.1 * rng.normal(size=(n, 6))
    x[n // 3 : 2 * n // 3] = x[3]
    return [(i, int(rng.integers(0, 4)), x[i].tolist()) for i in range(n)]


SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize(("block", "leaf", "anchors", "windows"), [(32_768, 128, 16_384, 1024), (40, 5, 7, 11)])
def test_against_brute_force(spark, monkeypatch, block, leaf, anchors, windows):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", (1, block))
    monkeypatch.setattr(negatives, "LEAF", leaf)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "WINDOWS", windows)
    monkeypatch.setattr(negatives, "SAMPLE", 100 if block == 40 else 20_000)
    monkeypatch.setattr(negatives, "CELL_SAMPLE", 8)
    rows = sample(450, 4)
    rows += [rows[10], rows[10], (10, 1, rows[11][2]), (-30, 1, rows[0][2]), (None, 1, rows[0][2]), (600, None, rows[0][2]), (610, 1, None), (620, 1, []), (630, 1, [None] + [1.0] * 5), (640, 1, [float("nan")] * 6), (650, 1, [float("inf")] + [1.0] * 5), (660, 1, [1.0, 2.0]), (670, 1, [0.0] * 6), (680, 9, [1e300] * 6)]
    df = spark.createDataFrame([(i, lab, v, 1, "x") for i, lab, v in rows], SCHEMA + ", anchor int, x string")
    want = brute(rows, every=10)
    assert len(want) > 300 and got(df, every=10) == want


def test_few_rows_and_none(spark):
    df = spark.createDataFrame(sample(30, 2)[:3], SCHEMA)
    assert got(df, every=1) == brute(sample(30, 2)[:3], every=1)
    assert got(df.limit(0)) == [] and got(spark.createDataFrame([(100, 1, None)], SCHEMA)) == [] and got(spark.createDataFrame([(101, 1, [1.0])], SCHEMA)) == []


def test_large_numbers_stay_exact(spark):
    rows = [(i, i % 2, [c * 2.0**12 for c in v]) for i, _, v in sample(60, 8)]
    assert got(spark.createDataFrame(rows, SCHEMA), every=10) == brute(rows, every=10)


def test_bounds_hold_and_part_clustered_rows():
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(12, 8)).repeat(200, 0) + 0.02 * rng.normal(size=(2400, 8)))).astype(np.int64)
    most = int((x * x).sum(1).max())
    tree = vptree.Tree(vptree.augmented(x, most), 5)
    q = x[::97]
    low, high = tree.reach(np.concatenate((q.astype(float), np.zeros((len(q), 1))), 1), (q.astype(float) ** 2).sum(1), most)
    s = q @ x.T
    assert (s <= high[:, tree.leaf]).all() and (s >= low[:, tree.leaf]).all()
    assert (tree.route(vptree.augmented(x, most)) == tree.leaf).all()
    tenth = np.sort(s, axis=1)[:, -10]
    assert (high < tenth[:, None]).mean() > 0.25  # leaves that are never read


def test_query_against_its_sql(spark):
    import __spark_entry__ as e

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    df = e.queries()["op11_hard_negatives"](spark, sf)
    rel = con.execute(e.oracle_sql()["op11_hard_negatives"])
    columns = [d[0] for d in rel.description]
    want = sorted(rel.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want and len(want) > 50
