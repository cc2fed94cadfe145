import random

import numpy as np
import pyarrow as pa

from colloquy.llm import graph, jaccard
from colloquy.llm import textvec as tv
from colloquy.llm.shingles import ShingleSets


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, threshold):
    sets = [shingles(t) for _, t in rows]
    n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted([(rows[i][0], links[i], low.get(find(i))) for i in range(n)], key=str)


def test_recall_model_and_signatures():
    assert jaccard.recall(0.8, jaccard.prefix_depth(0.8, 0.999), jaccard.TREES, jaccard.POOL) >= 0.999
    rng = random.Random(0)
    words = [f"a{i}" for i in range(4000)]
    pairs, agree = [], []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(200)]
        other = base[:]
        for _ in range(4):
            other[rng.randrange(200)] = rng.choice(words)
        s = ShingleSets(tv.Texts(pa.array([" ".join(base), " ".join(other)]))).signatures(jaccard.POOL)
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        pairs.append(len(a & b) / len(a | b))
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(pairs) - np.mean(agree)) < 0.02 and np.abs(np.array(pairs) - agree).max() < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (100, 101), (300, 200), (300, 250)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200, 250: 200, 300: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(800)]
    rows = [(None, "a b c d e f"), (None, None), (900, "a b c d e f"), (901, None), (902, ""), (903, "one two"), (904, "two one"), (905, "one  two"), (906, "a " * 9000)]
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 150))]
        for k in range(rng.randint(1, 6)):
            copy = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((g * 10 + k, " ".join(copy)))
    rows += [rows[20], rows[20], rows[30]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    for size in (2048, 3):
        monkeypatch.setattr(jaccard, "BLOCK_TEXTS", size)
        got = sorted([(r.doc_id, r.n_links, r.class_id) for r in jaccard.join(docs).collect()], key=str)
        assert got == brute(rows, 0.8)
    assert jaccard.join(docs.limit(0)).count() == 0


def test_recall_just_above_the_threshold(spark):
    """Pairs of 0.8 to 0.86, held against the exact measure of every pair."""
    rng = random.Random(11)
    rows, want = [], 0
    for g in range(500):
        base = [f"g{g}x{j}" for j in range(rng.randint(60, 240))]
        other = base[:]
        for k in range(max(1, len(base) // 48)):  # each change takes five shingles out of both
            other[(k * len(base)) // max(1, len(base) // 48) + 3] = f"z{k}"
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        want += len(a & b) >= 0.8 * len(a | b)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    assert want > 300
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_links > 0").count() / 2
    assert 0.99 * want <= got <= want


def test_nearest_links_by_trial():
    for n in range(1, 40):
        all_links = [i / (n + m - i) for m in range(1, 80) for i in range(1, min(n, m) + 1) if 0.8 * (n + m - i) - 1e-9 <= i < n + m - i]
        assert jaccard.nearest_link(n, 0.8) == (min(all_links) if all_links else None)
    own = jaccard.own_depths(np.array([3, 6, 8, 1000]), 0.8, 0.999)  # a set of 8 can lie in one of 10; one of 6 is at least 5/6 like its like
    assert own[0] == jaccard.DEPTH + 1 > own[1] > own[2] == own[3] == jaccard.prefix_depth(0.8, 0.999)


def test_a_subtrie_is_joined_like_a_plain_search():
    """Texts are joined exactly if a chain of pairs shares long enough prefixes and agrees in enough values."""
    rng = np.random.default_rng(5)
    floor, longest = 7, jaccard.DEPTH
    for _ in range(40):
        n = int(rng.integers(3, 30))
        rest = np.sort(rng.integers(0, 3, n) * (1 << 32) + rng.integers(0, 2, n) * (1 << 16)).astype(np.uint64)
        values = rng.integers(0, 2, (n, jaccard.POOL)).astype(np.uint8)
        own = rng.integers(7, 14, n)
        root = list(range(n))
        for i in range(n):
            for j in range(i):
                same = floor
                while same < longest and int(rest[i]) >> 8 * (longest - same - 1) == int(rest[j]) >> 8 * (longest - same - 1):
                    same += 1
                if same >= max(own[i], own[j]) and (values[i] == values[j]).sum() >= 84:
                    root = [root[j] if r == root[i] else r for r in root]
        mine = list(range(n))
        for i, j in jaccard.branches(rest, values, own, floor, 84):
            mine = [mine[i] if r == mine[j] else r for r in mine]
        assert all((root[i] == root[j]) == (mine[i] == mine[j]) for i in range(n) for j in range(n))


def test_large_runs_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "RUN_TEXTS", 4)
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 5)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i] + [f"n{i}"] + base[i + 1 :])) for i in range(40)]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, low int, blocks int")
    assert sorted([(r.doc_id, r.n_links, r.class_id) for r in jaccard.join(docs).collect()], key=str) == brute(rows, 0.8)


def test_representatives_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 77, 5, "x"), (2, "a b c d e f", 88, 6, "y"), (2, "a b c d e f", 88, 6, "y"), (3, None, 99, 7, None), (None, "a b c d e f", 1, 2, "z"), (None, "a b c d e f", 1, 2, "z"), (3, None, 99, 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rank int, rank int, `node.key` string")
    got = jaccard.representatives(docs)
    assert got.schema == docs.schema
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3], rows[3], rows[4], rows[4]], key=str)
    assert jaccard.representatives(docs.limit(0)).count() == 0


def test_representatives_of_repeated_ids(spark):
    """What stays is judged by id and text: a copy goes though its id has another text that stays, and a class keeps one row."""
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(2, a), (5, b), (5, a), (5, b), (7, b), (8, a.replace(" ", "  ")), (9, ""), (9, None), (9, "  "), (9, ""), (None, a), (2, a.replace(" ", "\t"))]
    got = jaccard.representatives(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id int, text string, key int")).collect()
    kept = sorted((str(r.doc_id), "-" if r.text is None else " ".join(r.text.split())) for r in got)
    assert kept == sorted([("2", a), ("5", b), ("9", ""), ("9", "-"), ("9", ""), ("9", ""), ("None", a)])
    many = spark.createDataFrame([(1, a), (2, a)], "doc_id long, text string").union(spark.range(10, 100_010).selectExpr("id as doc_id", "if(id % 2 = 0, '', null) as text"))
    assert jaccard.representatives(many).count() == 100_001


def test_components_with_hubs(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(5, i) for i in range(1000, 1400)] + [(1399, 2000)] + [(3000 + i, 2000) for i in range(50)] + [(9000, 9001)] + [(rng.randint(4000, 4200), rng.randint(4000, 4200)) for _ in range(150)]
    root = {n: n for e in edges for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    for hub, most in ((20, 100), (20, 1), (3, 1000)):
        monkeypatch.setattr(graph, "HUB", hub)
        monkeypatch.setattr(graph, "MOST_HUBS", most)
        got = {r.node: r.component for r in graph.components(df).collect()}
        assert got == {n: find(n) for n in root if any(n in e and e[0] != e[1] for e in edges)}
