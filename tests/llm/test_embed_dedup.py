import math

import numpy as np

from colloquy.llm import embed_dedup


def brute(rows, threshold):
    unit = []
    for i, lab, v in rows:
        ok = i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted([(rows[i][0], links[i], low.get(find(i)), rows[i][0] is None or rows[i][0] == low[find(i)]) for i in range(n)], key=str)


def test_link_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(60):
        base = rng.normal(size=8)
        for k in range(rng.integers(1, 8)):
            rows.append((g * 10 + k, int(g % 3), [float(x) for x in base + rng.normal(size=8) * rng.choice([0, 0.05, 0.12, 0.3])]))
    rows += [(900, 1, None), (901, None, rows[0][2]), (902, 0, [0.0] * 8), (903, 0, [1.0, None] + [0.0] * 6), (904, 0, [float("nan")] + [1.0] * 7), (905, 0, [float("inf")] + [1.0] * 7), (906, 0, []), (907, 0, [1.0, 0.0])]
    rows += [(None, 0, rows[0][2]), (950, rows[5][1], rows[5][2]), rows[5], rows[5], (951, rows[5][1], [2 * x for x in rows[5][2]])]
    df = spark.createDataFrame([(i, lab, v, 1) for i, lab, v in rows], "vec_id long, label int, embedding array<double>, node int")
    for cell, block in ((2048, 1024), (10, 7)):
        monkeypatch.setattr(embed_dedup, "CELL", cell)
        monkeypatch.setattr(embed_dedup, "BLOCK", block)
        for threshold in (0.98, 0.9):
            got = sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.link(df, threshold).collect()], key=str)
            assert got == brute(rows, threshold)
    assert embed_dedup.link(df.limit(0)).count() == 0


def test_cells_at_their_usual_size(spark):
    """A label of more than CELL vectors goes through k-means with the default settings, one of 50 has one cell; recall against all pairs is 1."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.12 * rng.normal(size=(4000, 16))
    rows = [(i, 0 if i < 3950 else 1, x[i].tolist()) for i in range(4000)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    same = np.arange(4000) < 3950
    hit = (unit @ unit.T >= 0.98) & (same[:, None] == same[None, :])
    np.fill_diagonal(hit, False)
    got = {r.vec_id: r.n_links for r in embed_dedup.link(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert hit.sum() > 1000 and got == dict(enumerate(hit.sum(1).tolist()))
