"""An inverted-file index of vectors: stored cells with bounds, which queries and rows meet by a join.

Spherical k-means on a bounded sample gives the cells; every row is laid into its nearest one, and each cell keeps the
smallest cosine of its rows to the centre. That bounds the cosine of a query to any row of the cell, so a search that reads only
the cells that can hold one of the k nearest is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators.knn import _matrix
from colloquy.sources import store

#: Rows that the centres are fitted on, bytes of centres (which go to every task), rows of a block, queries that meet a block in one task, queries multiplied at a time.
SAMPLE, CENTRE_BYTES, BLOCK, ASKED, SLICE = 20_000, 16 << 20, 4096, 8192, 512
#: What rounding of a product may amount to.
SLACK = 1e-6


def _units(rows: DataFrame, key: str, vector: str, name: str, width: int) -> DataFrame:
    """name, v: the bytes of the unit vector of each row with a usable one of this length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = _matrix(batch.column("v"), width)
            yield pa.RecordBatch.from_arrays([batch.column(name).take(pa.array(ok)), pa.array([r.tobytes() for r in x], pa.binary())], names=[name, "v"])

    return rows.select(F.col(key).cast("long").alias(name), F.col(vector).alias("v")).filter(F.col(name).isNotNull()).mapInArrow(run, f"{name} long, v binary")


def _stack(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centres of unit vectors, the first ones spread over the rows; a centre that no row is nearest to stays where it is."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(length > 1e-9, total / np.maximum(length, 1e-9), c)
    return c


def best(q: np.ndarray, centre: np.ndarray, reach: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For unit queries and cells, the highest cosine that a row of the cell can have; an empty cell has none."""
    near = np.arccos(np.clip(q @ centre.T, -1, 1)) - np.arccos(np.clip(reach, -1, 1))[None, :]
    return np.where(size[None, :] > 0, np.cos(np.maximum(near, 0)) + SLACK, -np.inf)


@dataclass
class Index:
    """Rows (id, v, cell), and of each cell its centre, its rows' smallest cosine to it, and how many they are."""

    rows: DataFrame
    centre: np.ndarray
    reach: np.ndarray
    size: np.ndarray

    def search(self, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", threshold: float | None = None, skip_self: bool = True) -> DataFrame:
        """qid, id, score (cosine, six decimals), rank: the k nearest rows of each query, ties by id.

        A query first visits the cell that can hold its nearest row. What the k-th of these scores leaves in reach it
        visits in a second round; queries stay in tasks throughout. A cell of many rows meets in blocks, in a task each, and so do
        very many queries of one cell. The threshold is applied after the k are chosen. Queries whose vector is null, zero, incomplete or of another length have no
        row; queries of one id have to have one vector.
        """
        width = self.centre.shape[1]
        none = queries.sparkSession.createDataFrame([], "qid long, id long, score double, rank int")
        if not width or not self.size.sum():
            return none
        asked = store.written(_units(queries, key, vector, "qid", width).dropDuplicates(["qid"]), "asked")
        parts = max(1, math.ceil(asked.count() / ASKED))
        first = store.written(self._round(asked.withColumn("floor", F.lit(-2.0)), k, parts, skip_self, opening=True), "first")
        place = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        floors = first.withColumn("r", F.row_number().over(place)).filter(F.col("r") == k).select("qid", F.col("score").alias("floor"))
        rest = self._round(asked.join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0))), k, parts, skip_self, opening=False)
        found = first.union(rest).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
        return found if threshold is None else found.filter(F.col("score") >= threshold)

    def _round(self, asked: DataFrame, k: int, parts: int, skip_self: bool, opening: bool) -> DataFrame:
        """qid, id, score of at most k rows a query and block: opening, of the cell that comes first; else of all others that reach the query's floor."""
        width, cells = self.centre.shape[1], (self.centre, self.reach, self.size)
        blocks = np.ceil(self.size / BLOCK).astype(np.int64)

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    bound = best(_stack(part.column("v"), width), *cells)
                    top = bound.argmax(1)
                    meets = np.zeros(bound.shape, bool)
                    if opening:
                        meets[np.arange(len(top)), top] = True
                    else:
                        meets = bound >= part.column("floor").to_numpy()[:, None]
                        meets[np.arange(len(top)), top] = False
                    row, cell = np.nonzero(meets)
                    count = blocks[cell]
                    row, cell = np.repeat(row, count), np.repeat(cell, count)
                    block = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in ("qid", "v", "floor")), pa.array(cell), pa.array(block)], names=["qid", "v", "floor", "cell", "block"])

        def meet(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if rows.num_rows and asked.num_rows:
                ids, x = rows.column("id").to_numpy(), _stack(rows.column("v"), width)
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                for at in range(0, asked.num_rows, SLICE):
                    part = asked.slice(at, SLICE)
                    qid = part.column("qid").to_numpy()
                    s = np.round(_stack(part.column("v"), width) @ x.T, 6) + 0.0
                    if skip_self:
                        s[qid[:, None] == ids[None, :]] = -np.inf
                    keep = s >= np.maximum(part.column("floor").to_numpy(), -2.0)[:, None]
                    if len(ids) > k:
                        # ids ascend, so a stable order gives equal scores to the smaller ids
                        nearest = np.argsort(-s, axis=1, kind="stable")[:, :k]
                        chosen = np.zeros(s.shape, bool)
                        np.put_along_axis(chosen, nearest, True, axis=1)
                        keep &= chosen
                    i, j = np.nonzero(keep)
                    out.append((qid[i], ids[j], s[i, j]))
            return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["qid", "id", "score"])

        visits = asked.mapInArrow(visit, "qid long, v binary, floor double, cell long, block long").withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)))
        count = F.broadcast(self.rows.sparkSession.createDataFrame([(i, int(b)) for i, b in enumerate(blocks.tolist()) if b], "cell long, blocks long"))
        rows = self.rows.join(count, "cell").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks"))).drop("blocks").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        by = ("cell", "block", "part")
        return rows.groupBy(*by).cogroup(visits.groupBy(*by)).applyInArrow(meet, "qid long, id long, score double")


def build(corpus: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding") -> Index:
    """Store an index of corpus below path, a folder that all executors share, and open it.

    Vectors of the most common length that are not null, zero or incomplete are indexed, each; the centres are fitted on about SAMPLE of them,
    which decides only how much a search reads.
    """
    lengths = corpus.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    width, spark = (lengths.n if lengths else 0), corpus.sparkSession
    schema = "id long, v binary, cell long"
    if not width:
        spark.createDataFrame([], schema).write.parquet(f"{path}/rows")
        spark.createDataFrame([], "cell long, centre binary, reach double, size long").write.parquet(f"{path}/cells")
        return opened(spark, path)
    units = _units(corpus, key, vector, "id", width)
    n = units.count()
    most = max(1, min(math.ceil(n / BLOCK), CENTRE_BYTES // (8 * width)))
    share = min(1.0, SAMPLE / max(1, n))
    picked = units.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.lit(math.ceil(share * 1_000_003))).limit(2 * SAMPLE).orderBy("id").toArrow()
    x = _stack(picked.column("v"), width)
    c = centres(x, min(most, max(1, len(x) // 16))) if len(x) else np.zeros((0, width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _stack(batch.column("v"), width) @ c.T
            cell = s.argmax(1) if len(c) else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(s[np.arange(len(s)), cell] if len(c) else np.full(len(s), -1.0))], names=["id", "v", "cell", "near"])

    placed = units.mapInArrow(assign, "id long, v binary, cell long, near double")
    placed.write.parquet(f"{path}/rows")
    facts = spark.read.schema("cell long, near double").parquet(f"{path}/rows").groupBy("cell").agg(F.min("near").alias("reach"), F.count("*").alias("size"))
    made = spark.createDataFrame([(i, r.tobytes()) for i, r in enumerate(c if len(c) else np.eye(1, width))], "cell long, centre binary")
    made.join(facts, "cell", "left").select("cell", "centre", F.coalesce("reach", F.lit(1.0)).alias("reach"), F.coalesce("size", F.lit(0)).cast("long").alias("size")).write.parquet(f"{path}/cells")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    """A stored index. The driver holds its centres, at most CENTRE_BYTES."""
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()
    centre = np.stack([np.frombuffer(b) for b in cells.column("centre").to_pylist()]) if cells.num_rows else np.zeros((0, 0))
    return Index(spark.read.schema("id long, v binary, cell long").parquet(f"{path}/rows"), centre, cells.column("reach").to_numpy(), cells.column("size").to_numpy())


def top_k(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", threshold: float | None = None, skip_self: bool = True) -> DataFrame:
    """knn.top_k by an index that is made for it, for queries in any number."""
    return build(corpus, store.shared_dir(queries.sparkSession, "index"), key, vector).search(queries, k, key, vector, threshold, skip_self)


def by_keyword(asked: DataFrame, index: Index, question: str, keyword: str, embed, k: int, least: float) -> DataFrame:
    """question, keyword, id, score, rank: the k rows nearest to each keyword, those from `least` on.

    asked: question, keywords (array; null, blank and repeated ones are passed over). Each different keyword is embedded and searched once, whatever the number of questions that
    hold it. embed: a column function text -> vector.
    """
    pairs = asked.select(question, F.explode(F.array_distinct(keyword)).alias("keyword")).filter(F.trim("keyword") != "")
    words = pairs.select("keyword").distinct().withColumn("_word", F.xxhash64("keyword"))
    hits = index.search(words.select("_word", embed(F.col("keyword")).alias("_v")), k, "_word", "_v", least, skip_self=False)
    named = hits.withColumnRenamed("qid", "_word").join(words, "_word").drop("_word")
    return pairs.join(named, "keyword").select(question, "keyword", "id", "score", "rank")
