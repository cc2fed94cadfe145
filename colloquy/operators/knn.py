"""Exact nearest neighbours by blocked products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.sources import store

#: Queries that are sent to tasks at a time, and corpus rows that a task multiplies with them at a time.
BLOCK, SLICE = 4096, 512


def _matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a usable vector of `width` numbers (that of the first usable one if not given), and the unit vectors."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64) if len(flat) else np.zeros(0)
    end = np.cumsum(size)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    ok = np.flatnonzero((size > 0) & (bad[end] == bad[end - size]))
    if not len(ok):
        return ok, np.zeros((0, width or 0))
    width = width or int(size[ok[0]])
    ok = ok[size[ok] == width]
    x = values[(end[ok] - width)[:, None] + np.arange(width)]
    norm = np.sqrt((x * x).sum(1))
    use = np.isfinite(norm) & (norm > 0)
    return ok[use], x[use] / norm[use, None]


def top_k(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", threshold: float | None = None, skip_self: bool = True, block: int = BLOCK) -> DataFrame:
    """qid, id, score (cosine, six decimals), rank: the k nearest corpus rows of each query, ties by id.

    Up to `block` queries are sent to tasks: a task multiplies them with SLICE corpus rows at a time, keeps the k best of each query, and
    passes those on at its end, so the shuffle holds k rows a query and task. More queries stay where they are, equal
    ones ask once, and they meet the different vectors of the corpus through an index (see vector_index). The threshold is applied after the k are chosen.
    Null, zero and incomplete vectors, and those of another length, are nobody's neighbour.
    """
    asked = queries.select(F.col(key).cast("long").alias("qid"), F.col(vector).alias("v"))
    if asked.limit(block + 1).count() > block:
        return _of_different(asked, corpus.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")), k, threshold, skip_self, block)
    rows = asked.orderBy("qid").toArrow()
    ok, q = _matrix(rows.column("v").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float64())))
    ids = rows.column("qid").to_numpy()[ok] if len(ok) else np.zeros(0, np.int64)
    found = corpus.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(_nearest(ids, q, k, skip_self), "qid long, id long, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best if threshold is None else best.filter(F.col("score") >= threshold)


def _of_different(asked: DataFrame, corpus: DataFrame, k: int, threshold: float | None, skip_self: bool, block: int) -> DataFrame:
    """top_k of many queries (qid, v) against corpus (id, v): equal vectors ask once, and only their smallest ids can be among the k nearest, as ties go by id."""
    from colloquy.operators import vector_index

    # one more, which is left out where it is the query itself
    most = k + int(skip_self)
    first = corpus.filter("v is not null and id is not null").withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("_n") <= most).select("id", "v")
    known = asked.filter("v is not null and qid is not null")
    of = store.written(known.join(known.groupBy("v").agg(F.min("qid").alias("like")), "v").select("qid", "like", "v"), "alike")
    different = of.filter("qid = like").dropDuplicates(["like"]).select("like", "v")
    if different.limit(block + 1).count() > block:
        near = vector_index.top_k(different, first.withColumnRenamed("id", "like"), most, "like", "v", None, False)
    else:
        near = top_k(different, first.withColumnRenamed("id", "like"), most, "like", "v", None, False, block)
    found = of.select("qid", "like").join(near.select(F.col("qid").alias("like"), "id", "score"), "like").drop("like")
    if skip_self:
        found = found.filter("qid <> id")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "id", "score", "rank")
    return best if threshold is None else best.filter(F.col("score") >= threshold)


def _nearest(ids: np.ndarray, q: np.ndarray, k: int, skip_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the k best so far, by query: query, id, score
        row, own, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(len(ids), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows if len(ids) else 0, SLICE):
                part = batch.slice(at, SLICE)
                ok, x = _matrix(part.column("v"), q.shape[1])
                if not len(ok):
                    continue
                new = part.column("id").to_numpy()[ok]
                s = np.round(q @ x.T, 6) + 0.0
                if skip_self:
                    s[ids[:, None] == new[None, :]] = -np.inf
                i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                row, own, score = np.concatenate((row, i)), np.concatenate((own, new[j])), np.concatenate((score, s[i, j]))
                order = np.lexsort((own, -score, row))
                row, own, score = row[order], own[order], score[order]
                first = np.searchsorted(row, np.arange(len(ids)))
                keep = np.arange(len(row)) - first[row] < k
                row, own, score = row[keep], own[keep], score[keep]
                count = np.bincount(row, minlength=len(ids))
                full = count >= k
                last = np.cumsum(count) - 1
                least[full] = score[last[full]]
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(own), pa.array(score)], names=["qid", "id", "score"])

    return run


def point_scores(pairs: DataFrame, left: DataFrame, right: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float | None = None) -> DataFrame:
    """pairs (qid, id) with the cosine of their vectors by left joins; a missing one gives null. threshold clips to null."""
    from colloquy.functions.vector import dot, norm

    a = left.select(F.col(key).alias("qid"), F.col(vector).alias("_a"))
    b = right.select(F.col(key).alias("id"), F.col(vector).alias("_b"))
    score = F.round(dot(F.col("_a"), F.col("_b")) / (norm(F.col("_a")) * norm(F.col("_b"))), 6)
    out = pairs.join(a, "qid", "left").join(b, "id", "left").select("qid", "id", score.alias("score"))
    return out if threshold is None else out.withColumn("score", F.when(F.col("score") >= threshold, F.col("score")))
