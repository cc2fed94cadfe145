import numpy as np

from colloquy.llm import cluster, grid, whitening


def brute(rows, k=4):
    """vec_id, component, n, deviation, whitened, explained by the covariance matrix and whole-number sums."""
    x = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[(n * a - s) / n for a, s in zip(v, total, strict=True)] for v in fit])
    e, u = np.linalg.eigh(c.T @ c / n)
    out = {}
    for i, v in x:
        dev = [n * a - s for a, s in zip(v, total, strict=True)]
        for j in range(1, k + 1):
            d = u[:, -j] * (-1 if u[np.abs(u[:, -j]).argmax(), -j] < 0 else 1)
            out[(i, j)] = (n, sum(t * t for t in dev), float(np.array(dev) / n @ d / np.sqrt(e[-j])), float(e[-j] / e.sum()))
    return out


def vectors(n, width, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(n, width)) * np.linspace(2, 0.2, width))]


def check(got, want, n):
    assert len(got) == n
    for r in got:
        w = want[(r.vec_id, r.component)]
        assert (r.n, r.deviation) == w[:2]
        assert abs(r.whitened - w[2]) < 1e-8 * max(1, abs(w[2])) and abs(r.explained - w[3]) < 1e-9 and r.identity_error < 1e-9


def test_against_the_covariance_matrix(spark, monkeypatch):
    rows = vectors(300, 12)
    rows += [(300, rows[5][1]), (301, rows[5][1]), (301, rows[5][1]), (302, [0.0] * 12), (303, [-0.0] * 12)]
    want = brute(rows)
    bad = [(400, None), (401, []), (402, [None] + [1.0] * 11), (403, [float("nan")] * 12), (404, [float("-inf")] + [1.0] * 11), (405, [1.0] * 3), (406, [1e30] * 12)]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows + bad], "vec_id long, embedding array<double>, x string, n int").repartition(9)
    monkeypatch.setattr(whitening, "BLOCK", 7)
    check(whitening.whiten(df).collect(), want, 4 * len(rows))
    nameless = whitening.whiten(df.withColumn("vec_id", whitening.F.lit(None).cast("long"))).collect()
    assert len(nameless) == 4 * len(rows) and nameless[0].vec_id is None


def test_factors_meet_in_a_tree(spark):
    """More tasks than one merge takes give the factor of all rows."""
    rows = vectors(500, 6, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(70)
    x = grid.gridded(df, "embedding", 6)
    path = cluster.shared_dir(spark, "rows")
    x.repartition(70, "vec_id").write.parquet(path)
    conf = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "1k")
    try:
        w = whitening.fitted(spark.read.parquet(path), 6, 6)
    finally:
        spark.conf.set(conf, old)
    c = np.floor(256 * np.array([v for _, v in rows], np.float32).astype(float))
    c = c - c.mean(0)
    assert np.allclose(w.eigenvalues, np.linalg.eigvalsh(c.T @ c / 500)[::-1], rtol=1e-10) and w.identity_error < 1e-9 and abs(w.explained.sum() - 1) < 1e-12


def test_few_directions_and_large_numbers(spark):
    schema = "vec_id long, embedding array<double>"
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], schema)
    got = whitening.whiten(flat).collect()
    assert len(got) == 9 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    assert whitening.whiten(flat.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    far = [(i, [v * (1 << 12) for v in vec]) for i, vec in enumerate(np.random.default_rng(5).uniform(-1, 1, (200, 5)).tolist())]
    check(whitening.whiten(spark.createDataFrame(far, schema)).collect(), brute(far), 800)
    wide = [(i, [32 * a for a in v]) for i, v in far]
    got = whitening.whiten(spark.createDataFrame(wide, schema)).collect()
    assert {r.deviation is None for r in got} <= {True, False} and all(r.deviation in (None, brute(wide)[(r.vec_id, r.component)][1]) for r in got[:8]) and any(r.deviation is None for r in got)


def test_deviations_beyond_a_long():
    w = whitening.Whitener(10**12, np.array([10**18, -(10**18)], object), np.eye(2), np.ones(2), np.ones(2) / 2)
    d = w.deviations(np.array([[1 << 25, 3]]))
    assert d.tolist() == [[(1 << 25) * 10**12 - 10**18, 3 * 10**12 + 10**18]]
