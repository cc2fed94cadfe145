"""Whitening of vectors by a tall-skinny QR factorisation.

Rows are centred with exact sums, each task reduces its rows to a triangular factor, a tree of
merges joins the factors, and the singular values and right vectors of the last one whiten: the
covariance matrix is never formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import cluster, grid

#: Rows that a task factorises at a time, and factors that meet in one merge.
BLOCK, FAN = 2048, 8
LONG = np.iinfo(np.int64).max


@dataclass
class Whitener:
    """n distinct vectors with sums `total`, their first principal directions (rows), eigenvalues, shares of the variance, and the error of the whitened covariance."""

    n: int
    total: np.ndarray  # of Python ints
    directions: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - total, exact: as longs where they fit, else as Python ints."""
        most = self.n * int(np.abs(x).max(initial=0)) + max((abs(t) for t in self.total), default=0)
        if most < LONG:
            return self.n * x - self.total.astype(np.int64)
        return self.n * x.astype(object) - self.total

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = (self.deviations(x) / self.n).astype(np.float64)
        return centred @ self.directions.T / np.sqrt(self.eigenvalues)


def _sums(fit: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums by dimension: tasks sum the upper and lower bits apart, one row a dimension each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = grid.unpack(batch.column("x"), width)
            n, high, low = n + len(x), high + (x >> 16).sum(0), low + (x & 0xFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(high), pa.array(low), pa.array(np.full(width, n))], names=["dim", "high", "low", "n"])

    parts = fit.mapInArrow(run, "dim long, high long, low long, n long").groupBy("dim").agg(*(F.sum(c).alias(c) for c in ("high", "low", "n"))).orderBy("dim").collect()
    return (parts[0].n if parts else 0), np.array([(r.high << 16) + r.low for r in parts], object)


def _factor(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x, mode="r")


def fitted(fit: DataFrame, width: int, components: int) -> Whitener | None:
    """The whitener of the rows of fit (x), which has to be a written table; None without a row.

    At most `components` directions; those without variance beyond rounding are left out. Moved are a row of sums a dimension
    and task, and a triangular factor (width x width) a task, which meet FAN at a time; the driver gets sums, eigenvalues and directions.
    """
    n, total = _sums(fit, width)
    if not n:
        return None
    plain = Whitener(n, total, np.zeros((0, width)), np.zeros(0), np.zeros(0))

    def factorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = grid.unpack(batch.column("x").slice(at, BLOCK), width)
                r = _factor(np.vstack((r, (plain.deviations(x) / n).astype(np.float64))))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r.tobytes()])], names=["part", "r"])

    def stacked(table: pa.Table) -> np.ndarray:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")  # the order of arrival does not matter
        return np.frombuffer(b"".join(table.column("r").take(pa.array(order)).to_pylist())).reshape(-1, width)

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"part": [table.column("part")[0].as_py() // FAN], "r": [_factor(stacked(table)).tobytes()]})

    def decompose(table: pa.Table) -> pa.Table:
        _, s, v = np.linalg.svd(stacked(table), full_matrices=False)
        v = v[:components]
        v = v * np.where(v[np.arange(len(v)), np.abs(v).argmax(1)] < 0, -1.0, 1.0)[:, None]
        return pa.table({"s": [s.tobytes()], "v": [v.tobytes()]})

    factors = cluster.written(fit.mapInArrow(factorise, "part long, r binary"), "factors")
    top = factors.agg(F.max("part")).first()[0]
    while top >= FAN:
        factors = factors.groupBy(F.floor(F.col("part") / FAN).alias("to")).applyInArrow(merge, "part long, r binary")
        top //= FAN
    last = factors.groupBy(F.lit(0).alias("to")).applyInArrow(decompose, "s binary, v binary").first()
    s, v = np.frombuffer(last.s), np.frombuffer(last.v).reshape(-1, width)
    eigen = s * s / n
    rank = int((s > s.max(initial=0.0) * max(width, 32) * np.finfo(float).eps).sum()) if s.max(initial=0.0) > 0 else 0
    k = min(components, rank, len(v))
    done = Whitener(n, total, v[:k].copy(), eigen[:k], eigen[:k] / eigen.sum() if k else eigen[:0])

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, z1 = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            z = done.whitened(grid.unpack(batch.column("x"), width))
            g, z1 = g + z.T @ z, z1 + z.sum(0)
        i, j = np.indices((k + 1, k))  # row k: the sums
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(np.vstack((g, z1)).ravel())], names=["i", "j", "v"])

    if k:
        both = np.zeros((k + 1, k))
        for row in fit.mapInArrow(gram, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            both[row.i, row.j] = row.v
        mean = both[k] / n
        done.identity_error = float(np.abs(both[:k] / n - np.outer(mean, mean) - np.eye(k)).max())
    return done


def whiten(vectors: DataFrame, components: int = 4, vector: str = "embedding") -> DataFrame:
    """Principal components of vectors (vec_id, embedding) on the grid x = floor(256 * c), whitened: one row a vector and component.

    The fit list is each distinct x once: its n rows have sums S and covariance V (divisor n). Returns vec_id, component (from 1 by
    falling eigenvalue e), n, deviation (sum of (n * x - S)^2, exact), whitened (x - S / n on the component, over sqrt(e)),
    explained (e / trace of V) and identity_error (largest entry of the whitened fit list's covariance minus the identity).

    Null and empty vectors, those with a null or non-finite component or one of 2^18 or more, and those of another length than the most
    common one (of equally common ones the shortest) give no rows. Components without variance give none, so equal vectors or a single
    one give no rows, nor does an empty table. Repeated rows and rows with a null vec_id are returned each; equal vectors count once in
    the fit. A deviation beyond a long is null. Other columns are not read. The sign of a component is that which makes its
    largest entry positive. Memory: a task holds FAN factors of width x width numbers, so a width of some 4,000 is the most.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = grid.width(rows, "v")
    on_grid = grid.gridded(rows, "v", width)
    w = fitted(cluster.written(on_grid.select("x").distinct(), "fit"), width, components) if width else None
    if w is None or not len(w.eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema)
    k = len(w.eigenvalues)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = grid.unpack(part.column("x"), width)
                d = w.deviations(x)
                if d.dtype == object or int(np.abs(d).max(initial=0)) ** 2 * width > LONG:
                    d = d.astype(object)
                square = [v if v <= LONG else None for v in (d * d).sum(1).tolist()]
                n = len(x)
                every = np.repeat(np.arange(n), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, w.n)), pa.array(square, pa.int64()).take(pa.array(every)),
                        pa.array(w.whitened(x).ravel()), pa.array(np.tile(w.explained, n)), pa.array(np.full(n * k, w.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return on_grid.mapInArrow(project, schema)
