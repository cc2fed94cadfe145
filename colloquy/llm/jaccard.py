"""Similarity join of texts by the Jaccard measure of their word shingles.

A MinHash LSH forest gives candidates. Each tree is a trie of labels, some MinHash values of a text
in a fixed order; sorted labels are its leaves. Two texts are first matched where they share a whole
label; matched prefixes are then shortened one value at a time, for each text until the trees meet
every text that it can be linked to with the target recall. Matched texts whose whole signatures do
not rule out a link are candidates. They form clusters, in which pairs are verified exactly by
blocked products of shingle incidences; pairs are counted there, never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm import cluster, graph
from colloquy.llm import textvec as tv
from colloquy.llm.shingles import ShingleSets

#: Trees, values of a label, and MinHash values that labels are drawn from (one byte each).
TREES, DEPTH, POOL = 40, 12, 160
#: Most texts of a run that are matched in one task, and of a cluster block in one task, and shingles of a block.
RUN_TEXTS, BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1024, 1_000_000


def recall(similarity: float, depth: int, trees: int, pool: int) -> float:
    """Expected share of pairs of this similarity that share a prefix of `depth` in one of the trees, whose values are drawn from a pool of MinHashes."""
    total = 0.0
    for k in range(pool + 1):
        p = math.comb(pool, k) * similarity**k * (1 - similarity) ** (pool - k)
        total += p * (1 - (1 - (k / pool) ** depth) ** trees)
    return total


@lru_cache(1024)
def prefix_depth(threshold: float, target: float, trees: int = TREES, longest: int = DEPTH, pool: int = POOL) -> int:
    """The longest prefix with the target recall at the threshold."""
    for depth in range(longest, 1, -1):
        if recall(threshold, depth, trees, pool) >= target:
            return depth
    return 1


def nearest_link(size: int, threshold: float) -> float | None:
    """The smallest measure of at least the threshold that a set of so many elements can have with a different set; None if it can have none."""
    best = None
    for other in range(math.ceil(threshold * size - 1e-9), math.floor(size / threshold + 1e-9) + 1):
        common = math.ceil(threshold * (size + other) / (1 + threshold) - 1e-9)
        union = size + other - common
        if common <= min(size, other) and common < union:
            best = common / union if best is None else min(best, common / union)
    return best


def own_depths(sizes: np.ndarray, threshold: float, target: float, longest: int = DEPTH) -> np.ndarray:
    """For each text the length down to which its matched prefixes are shortened: until texts as unlike it as a link allows are met with the target recall. longest + 1: it can be linked to no other text."""
    unique, inverse = np.unique(sizes, return_inverse=True)
    out = []
    for n in unique.tolist():
        least = threshold if n > 200 else nearest_link(n, threshold)
        out.append(longest + 1 if least is None else prefix_depth(round(least, 4), target))
    return np.array(out, np.int64)[inverse]


def least_agreement(threshold: float, risk: float = 1e-6, pool: int = POOL) -> int:
    """Equal values among the pool below which a pair at the threshold falls with at most this probability."""
    total = 0.0
    for k in range(pool + 1):
        total += math.comb(pool, k) * threshold**k * (1 - threshold) ** (pool - k)
        if total > risk:
            return k
    return pool


def labels(values: np.ndarray, trees: int = TREES, longest: int = DEPTH) -> np.ndarray:
    """Texts x trees x values: each tree has an order of its own on the signatures' values."""
    rng = np.random.default_rng(78)
    order = np.stack([rng.permutation(values.shape[1])[:longest] for _ in range(trees)])
    return values[:, order]


def entries(values: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text and tree the hash of the label's first `floor` values, and the others as a number in whose order labels are sorted."""
    lab = labels(values).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), lab.shape[:2])
    for j in range(floor):
        key = tv.mix(key ^ lab[:, :, j], 31)
    rest = np.zeros(lab.shape[:2], np.uint64)
    for j in range(floor, min(DEPTH, floor + 7)):
        rest = (rest << np.uint64(8)) | lab[:, :, j]
    return key, rest


def branches(rest: np.ndarray, values: np.ndarray, own: np.ndarray, floor: int, agreement: int) -> list[tuple[int, int]]:
    """Joins of the texts of one subtrie (sorted by rest): pairs that connect all of them that share a long enough prefix and agree in enough values.

    From whole labels on the prefix is shortened step by step; texts that longer prefixes have joined are not compared again.
    """
    longest = min(DEPTH, floor + 7)
    root, out = np.arange(len(rest)), []
    for depth in range(longest, floor - 1, -1):
        code = rest >> np.uint64(8 * (longest - depth))
        cut = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True])))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a < 2 or (root[a:b] == root[a]).all():
                continue
            at = a + np.flatnonzero(own[a:b] <= depth)
            while len(at) > 1 and not (root[at] == root[at[0]]).all():
                others = at[root[at] != root[at[0]]]
                hit = others[(values[others] == values[at[0]]).sum(1) >= agreement]
                roots, first = np.unique(root[hit], return_index=True)
                out += [(int(at[0]), int(j)) for j in hit[first]]
                root[np.isin(root, roots)] = root[at[0]]
                at = at[1:]
    return out


def linked(sets: list[np.ndarray], weights: np.ndarray, threshold: float, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each set the weight of the other sets at or above the threshold, and the first set that it is joined to through such links.

    split: only pairs of one set before and one at or after it; None: all pairs.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    count, parent = np.zeros(n, np.int64), np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    whole = np.concatenate(sets)
    of = np.repeat(np.arange(n), sizes.astype(np.int64))
    values, column, times = np.unique(whole, return_inverse=True, return_counts=True)
    common = times > 1
    place = np.cumsum(common) - 1
    keep = common[column]
    row, column, width = of[keep], place[column[keep]], int(common.sum())
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = (np.arange(n), np.arange(n)) if split is None else (np.arange(split), np.arange(split, n))
    inter = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, width, 1024):
        a, b = np.searchsorted(column, [at, at + 1024])
        part = np.zeros((n, min(1024, width - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        inter += part[left] @ part[right].T
    factor = threshold / (1 + threshold)
    for i in range(len(left)):
        hit = inter[i] >= factor * (sizes[left[i]] + sizes[right]) - 1e-6
        if split is None:
            hit[i] = False
        to = np.flatnonzero(hit)
        if len(to):
            count[left[i]] += weights[right[to]].sum()
            if split is not None:
                count[right[to]] += weights[left[i]]
            root = find(left[i])
            for j in right[to].tolist():
                other = find(j)
                if other != root:
                    low, high = min(root, other), max(root, other)
                    parent[high] = low
                    root = low
    return count, np.array([find(i) for i in range(n)])


def join(docs: DataFrame, threshold: float = 0.8, target_recall: float = 0.999, text: str = "text") -> DataFrame:
    """Link texts of docs (doc_id, text) whose sets of five-word shingles have a Jaccard measure of at least the threshold.

    Returns one row per row of docs: doc_id, n_shingles, copy_id (smallest doc_id with the same
    shingles), n_links (other rows linked directly, copies among them), class_id (smallest doc_id
    reachable by links, itself included).

    Texts with equal sets are one node with a weight, whatever their number. A subtrie of more than
    RUN_TEXTS texts, and a cluster beyond BLOCK_TEXTS texts or BLOCK_SHINGLES shingles, is compared
    block by block in separate tasks. Links are exact; a pair at the threshold is missed with
    probability 1 - target_recall, a closer one more rarely.

    A text without words, or a null one, has no shingles and links with nothing; a text of one to
    four words has one shingle of all of them. A row with a null doc_id links with nothing (its
    copy_id and class_id are null). Repeated rows are copies of each other. An empty table gives
    no rows; other columns are not read.
    """
    return _classes(docs, threshold, target_recall, text).drop("tk")


def _classes(docs: DataFrame, threshold: float, target_recall: float, text: str) -> DataFrame:
    """join, with a hash of each row's text (tk)."""
    floor, agreement = prefix_depth(threshold, target_recall), least_agreement(threshold)
    rows = cluster.bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("tk"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches, "text"):
            sets = ShingleSets(tv.Texts(batch.column("text")))
            s1, s2 = sets.identity()
            values = sets.signatures(POOL).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tk"), tv.as_long(s1), tv.as_long(s2), pa.array(sets.sizes.astype(np.int64)), pa.array([v.tobytes() for v in values], pa.binary())],
                names=["doc_id", "tk", "s1", "s2", "n_shingles", "values"],
            )

    def matrix(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, POOL)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                node = part.column("node").to_numpy()
                use = own_depths(part.column("n_shingles").to_numpy(), threshold, target_recall) <= DEPTH
                key, rest = entries(matrix(part.column("values"))[use], floor)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[use], TREES)), tv.as_long(key.reshape(-1)), tv.as_long(rest.reshape(-1))], names=["node", "key", "rest"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Joins within each run of rows with one key, low and high; rows come sorted."""
        kept = None
        for batch in _and_last(batches):
            if batch is not None:
                kept = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            if kept is None or not kept.num_rows:
                continue
            key, low, high = (kept.column(c).to_numpy() for c in ("key", "low", "high"))
            cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]), [True])))
            if batch is not None:  # the last run may go on
                cut = cut[:-1]
            done = kept.slice(0, int(cut[-1]))
            kept = kept.slice(int(cut[-1])).combine_chunks()
            if len(cut) < 2:
                continue
            node, rest = done.column("node").to_numpy(), done.column("rest").to_numpy().view(np.uint64)
            values = matrix(done.column("values").combine_chunks())
            own = own_depths(done.column("n_shingles").to_numpy(), threshold, target_recall)
            a, size = cut[:-1], np.diff(cut)
            two = a[size == 2]
            longest = min(DEPTH, floor + 7)
            same = sum((rest[two] >> np.uint64(8 * (longest - d)) == rest[two + 1] >> np.uint64(8 * (longest - d))).astype(np.int64) for d in range(floor + 1, longest + 1))
            ok = (floor + same >= np.maximum(own[two], own[two + 1])) & ((values[two] == values[two + 1]).sum(1) >= agreement)
            left, right = [two[ok]], [two[ok] + 1]
            for x, n in zip(a[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                pairs = np.array(branches(rest[x : x + n], values[x : x + n], own[x : x + n], floor, agreement), np.int64).reshape(-1, 2) + x
                left.append(pairs[:, 0])
                right.append(pairs[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(node[np.concatenate(left)]), pa.array(node[np.concatenate(right)])], names=["a", "b"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set = set()
        for batch in tv.slices(batches, "text"):
            sets = ShingleSets(tv.Texts(batch.column("text")))
            s1 = sets.identity()[0].view(np.int64)
            node = batch.column("node").to_numpy()
            ok = [i for i in np.flatnonzero(s1 == node).tolist() if node[i] not in done]
            ok = list({int(node[i]): i for i in ok}.values())
            done.update(node[ok].tolist())
            at = pa.array(ok, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in ("cluster", "blocks", "node", "weight")] + [pa.array([sets.hashes[sets.bounds[i] : sets.bounds[i + 1]].tobytes() for i in ok], pa.binary())],
                names=["cluster", "blocks", "node", "weight", "members"],
            )

    def verify(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        _, first = np.unique(node, return_index=True)
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        block = table.column("block").to_numpy()[first]
        first = first[np.argsort(block, kind="stable")] if low != high else first
        node = node[first]
        weight = table.column("weight").to_numpy()[first]
        members = table.column("members")
        sets = [np.frombuffer(members[i].as_py(), np.uint64) for i in first.tolist()]
        split = None if low == high else int((table.column("block").to_numpy()[first] == low).sum())
        count, root = linked(sets, weight, threshold, split)
        return pa.table({"node": pa.array(node), "links": pa.array(count), "to": pa.array(node[root])})

    def by_block(df: DataFrame) -> DataFrame:
        """Each row with every block of its group: low and high name the two, and rows with equal ones meet."""
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        return df.withColumn("block", block).withColumn("other", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    signed = cluster.written(rows.filter("doc_id is not null").mapInArrow(sign, "doc_id long, tk long, s1 long, s2 long, n_shingles long, values binary"), "signatures")
    nodes = signed.filter("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("values").alias("values")).withColumnRenamed("s1", "node")
    leaves = nodes.select("node", "n_shingles", "values").mapInArrow(unfold, "node long, key long, rest long")
    inner = leaves.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / RUN_TEXTS).cast("int").alias("blocks"))
    shared = leaves.join(inner, "key").join(nodes.select("node", "n_shingles", "values"), "node")
    runs = by_block(shared).drop("other", "block").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "rest")
    clusters = graph.components(runs.mapInArrow(match, "a long, b long"), "clusters")

    sized = nodes.drop("values").join(clusters.withColumnRenamed("component", "cluster"), "node")
    blocks = sized.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = sized.join(blocks, "cluster").select("cluster", "blocks", "node", "weight", F.col("rep").alias("doc_id"))
    fetched = rows.join(members, "doc_id").mapInArrow(fetch, "cluster long, blocks int, node long, weight long, members binary")
    found = cluster.written(by_block(fetched).groupBy("cluster", "low", "high").applyInArrow(verify, "node long, links long, to long"), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = graph.components(found.select(F.col("node").alias("a"), F.col("to").alias("b")), "groups")
    own = nodes.select("node", "s2", "n_shingles", "rep", "weight").join(groups, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = own.groupBy("component").agg(F.min("rep").alias("class_id"))
    facts = own.join(least, "component").select(F.col("node").alias("s1"), "s2", "n_shingles", "rep", "class_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    judged = signed.filter("n_shingles > 0").join(facts, ["s1", "s2", "n_shingles"]).select("doc_id", "n_shingles", F.col("rep").alias("copy_id"), "n_links", "class_id", "tk")
    # those without words, and without an id, link with nothing: no join has them as one key
    wordless = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"), "tk")
    none = F.lit(None).cast("long")
    unknown = rows.filter("doc_id is null").select("doc_id", none.alias("n_shingles"), none.alias("copy_id"), F.lit(0).cast("long").alias("n_links"), none.alias("class_id"), "tk")
    return judged.union(wordless).union(unknown)


def _and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches and then None."""
    yield from batches
    yield None


def representatives(docs: DataFrame, threshold: float = 0.8, target_recall: float = 0.999, text: str = "text") -> DataFrame:
    """One row of each class (see join), all columns as they are: that with the smallest doc_id, of several texts under it one; of repeated rows one.

    A row of another class under the same doc_id stays with it, so what counts is doc_id and text together. Texts without words and rows with a null doc_id are in
    no class and stay. Columns may have any names.
    """
    body, tk, rank = F.col(f"`{text}`"), cluster.fresh(docs, "tk"), cluster.fresh(docs, "rank")
    first = _classes(docs, threshold, target_recall, text).filter("n_shingles > 0 and doc_id = class_id").groupBy("class_id").agg(F.min("tk").alias(tk)).withColumnRenamed("class_id", cluster.fresh(docs, "key"))
    words = body.isNotNull() & (F.length(F.translate(body, " \t\n\x0b\x0c\r", "")) > 0)
    classed = docs.filter(F.col("doc_id").isNotNull() & words).withColumns({tk: F.xxhash64(body), cluster.fresh(docs, "key"): F.col("doc_id").cast("long")})
    key = cluster.fresh(docs, "key")
    mine = classed.join(first, [key, tk], "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy(key, tk).orderBy(F.lit(0)))).filter(F.col(rank) == 1)
    return mine.select(*(F.col(f"`{c}`") for c in docs.columns)).union(docs.filter(F.col("doc_id").isNull() | ~words))
