"""Near-duplicates among vectors of one label.

Spherical k-means assigns vectors to cells, blocked cosine products compare within cells, and
one representative per group is kept. A vector near a border is also laid into the neighbour
cell, by a bound that no linked pair can escape, so cells lose no link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import cluster, graph
from colloquy.llm import textvec as tv

#: Vectors that k-means is fitted on and their bytes, vectors of a label from which on it has cells (two at least), vectors aimed at in a cell, bytes of centroids that are sent to tasks, vectors in a block.
SAMPLE, SAMPLE_BYTES, LEAST, CELL, CENTROID_BYTES, BLOCK = 20_000, 64 << 20, 32, 2048, 32 << 20, 1024


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, 1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


class Cells:
    """Centroids of labels with LEAST vectors or more; a label without has one cell."""

    def __init__(self, centroids: dict[tuple[int, int], np.ndarray], threshold: float):
        self.centroids = centroids
        self.margin = {}
        sine = math.sqrt(max(0.0, 1 - threshold * threshold))
        for key, c in centroids.items():
            self.margin[key] = sine * np.sqrt(np.maximum(0, 2 - 2 * c @ c.T)) + 1e-9

    def assign(self, label: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, own): each row's nearest cell, and those lower cells in which a linked vector can be nearest.

        If y is nearest to p, and x within the angle of y is nearest to c, then x lies on c's side of
        the plane between c and p, so y lies at most sin(angle) beyond it.
        """
        c = self.centroids.get((label, x.shape[1]))
        every = np.arange(len(x))
        if c is None:
            return every, np.zeros(len(x), np.int32), np.ones(len(x), bool)
        s = x @ c.T
        own = np.argmax(s, 1)
        spill = (s[every, own][:, None] - s <= self.margin[(label, x.shape[1])][own]) & (np.arange(len(c))[None, :] < own[:, None])
        row, cell = np.nonzero(spill)
        return np.concatenate((every, row)), np.concatenate((own, cell)).astype(np.int32), np.concatenate((np.ones(len(x), bool), np.zeros(len(row), bool)))


def _unit(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for null, zero, or with a null or non-finite component."""
    n = len(column)
    out: list[np.ndarray | None] = [None] * n
    if not n:
        return out
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()  # without what null lists may hide
    end = np.cumsum(size)
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    bad |= ~np.isfinite(values)
    upto = np.concatenate(([0], np.cumsum(bad)))
    for width in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero((size == width) & (upto[end] == upto[end - size]))
        x = values[(end[rows] - width)[:, None] + np.arange(width)]
        top = np.abs(x).max(1, initial=0)
        rows, x, top = rows[top > 0], x[top > 0], top[top > 0]
        x = x / top[:, None]
        x = x / np.sqrt((x * x).sum(1))[:, None]
        for i, v in zip(rows.tolist(), x, strict=True):
            out[i] = v
    return out


def link(vectors: DataFrame, threshold: float = 0.98, vector: str = "embedding") -> DataFrame:
    """Link vectors of vectors (vec_id, label, embedding) with equal labels and a cosine of at least the threshold.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable,
    itself included), kept (vec_id = component_id): one row per row.

    Equal vectors of a label are one node with a weight. Cells beyond BLOCK vectors are compared
    block by block in separate tasks; links are counted there, not listed. A label of LEAST vectors or more has two cells at
    least and one for each CELL vectors, as far as CENTROID_BYTES of centroids and a quarter of its sampled vectors go.
    k-means is fitted on about SAMPLE vectors of at most SAMPLE_BYTES, and only decides which tasks compare which vectors.

    A null label, a null or empty vector, one of zeros or with a null or non-finite component links
    with nothing; vectors of different length do not link. A row with a null vec_id links with
    nothing and is kept, its component_id null. Repeated rows are linked to each other. An empty
    table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vector).alias("embedding"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            unit = _unit(batch.column("embedding"))
            ok = [i for i, (lab, u) in enumerate(zip(labels, unit, strict=True)) if lab is not None and u is not None]
            h = np.zeros((len(ok), 2), np.uint64)
            with np.errstate(over="ignore"):
                for at, i in enumerate(ok):
                    bits = unit[i].view(np.uint64)
                    for k in (0, 1):
                        x = tv.mix(bits + tv.mix(np.arange(len(bits), dtype=np.uint64), 50 + k), k)
                        h[at, k] = x.sum(dtype=np.uint64)
                salt = tv.mix(np.array([labels[i] for i in ok], np.int64).view(np.uint64), 60)
                h = tv.mix(h + salt[:, None], 61)
            at = pa.array(ok, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(at), batch.column("label").take(at), tv.as_long(h[:, 0]), tv.as_long(h[:, 1]), pa.array([len(unit[i]) for i in ok], pa.int32()), pa.array([unit[i].tobytes() for i in ok], pa.binary())],
                names=["vec_id", "label", "s1", "s2", "width", "unit"],
            )

    signed = cluster.written(rows.filter("vec_id is not null").mapInArrow(sign, "vec_id long, label long, s1 long, s2 long, width int, unit binary"), "vectors")
    nodes = signed.groupBy("label", "width", F.col("s1").alias("node"), "s2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("unit").alias("unit"))

    counts = nodes.groupBy("label", "width").count()
    number = 8 * (counts.agg(F.max("width")).first()[0] or 1)
    most_cells, sample = CENTROID_BYTES // number, max(1, min(SAMPLE, SAMPLE_BYTES // (2 * number)))
    large = counts.filter(F.col("count") >= LEAST).orderBy(F.desc("count"), "label").limit(most_cells).collect()
    total = sum(r["count"] for r in large)
    centroids = {}
    if total:
        share = min(1.0, sample / total)
        picked = nodes.join(F.broadcast(vectors.sparkSession.createDataFrame([(r.label, r.width) for r in large], "label long, width int")), ["label", "width"])
        picked = picked.filter(F.pmod(F.xxhash64("node"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003))).select("label", "width", "unit").limit(2 * sample).collect()
        for r in large:
            x = [np.frombuffer(p.unit) for p in picked if p.label == r.label and p.width == r.width]
            k = min(max(2, math.ceil(r["count"] / CELL)), max(1, int(most_cells * r["count"] / total)), max(1, len(x) // 4))
            if k > 1 and len(x) > k:
                centroids[(r.label, r.width)] = spherical_kmeans(np.stack(x), k)
    cells = Cells(centroids, threshold)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, width = np.array(batch.column("label").to_pylist()), np.array(batch.column("width").to_pylist())
            unit = batch.column("unit").to_pylist()
            for lab, w in sorted(set(zip(label.tolist(), width.tolist(), strict=True))):
                at = np.flatnonzero((label == lab) & (width == w))
                row, cell, own = cells.assign(lab, np.frombuffer(b"".join(unit[i] for i in at), np.float64).reshape(-1, w))
                take = pa.array(at[row])
                yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("label", "width", "node", "weight", "unit")] + [pa.array(cell), pa.array(own)], names=["label", "width", "node", "weight", "unit", "cell", "own"])

    def compare(table: pa.Table) -> pa.Table:
        node, weight, own = table.column("node").to_numpy(), table.column("weight").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
        block = table.column("block").to_numpy()
        low, high, width = table.column("low")[0].as_py(), table.column("high")[0].as_py(), table.column("width")[0].as_py()
        order = np.lexsort((node, block))
        node, weight, own, block = node[order], weight[order], own[order], block[order]
        x = np.frombuffer(b"".join(table.column("unit").take(pa.array(order)).to_pylist()), np.float64).reshape(-1, width)
        split = len(node) if low == high else int((block == low).sum())
        base = 0 if low == high else split
        hit = (x[:split] @ x[base:].T >= threshold) & (own[:split, None] | own[None, base:])
        if low == high:
            np.fill_diagonal(hit, False)
        count = np.zeros(len(node), np.int64)
        count[:split] += hit @ weight[base:]
        if low != high:
            count[base:] += weight[:split] @ hit
        # the smallest index reached: spread minima over the links until nothing changes
        root = np.arange(len(node))
        i, j = np.nonzero(hit)
        j = j + base
        while len(i):
            best = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, best)
            np.minimum.at(new, j, best)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pa.table({"node": pa.array(node), "links": pa.array(count), "to": pa.array(node[root])})

    placed = cluster.written(nodes.drop("s2", "rep").mapInArrow(assign, "label long, width int, node long, weight long, unit binary, cell int, own boolean"), "cells")
    sizes = placed.groupBy("label", "width", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(sizes, ["label", "width", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    found = cluster.written(dealt.groupBy("label", "width", "cell", "low", "high").applyInArrow(compare, "node long, links long, to long").filter("links > 0"), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = graph.components(found.select(F.col("node").alias("a"), F.col("to").alias("b")), "groups")
    own = nodes.select("node", "s2", "rep", "weight").join(groups, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = own.groupBy("component").agg(F.min("rep").alias("component_id"))
    facts = own.join(least, "component").select(F.col("node").alias("s1"), "s2", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    usable = signed.select("vec_id", "s1", "s2").join(facts, ["s1", "s2"]).select("vec_id", "n_links", "component_id")

    def useless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = [i is None or lab is None or u is None for i, lab, u in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), _unit(batch.column("embedding")), strict=True)]
            yield batch.filter(pa.array(bad, pa.bool_())).select(["vec_id"])

    rest = rows.mapInArrow(useless, "vec_id long").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
