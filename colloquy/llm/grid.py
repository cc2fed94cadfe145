"""Vectors laid on a grid of whole numbers: floor(scale * component), kept in as few bytes as hold them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import cluster

#: Components are floor(SCALE * c). One with an absolute value from LIMIT on counts as non-finite, so that sums of products of 1,024 such numbers fit a long.
SCALE, LIMIT = 256, 1 << 26
TYPES = (np.dtype("<i2"), np.dtype("<i4"))


def usable(vector: Column) -> Column:
    """True for a vector with components, all of them finite numbers below the limit."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float(LIMIT // SCALE))), F.lit(False))


def width(rows: DataFrame, vector: str) -> int:
    """The most common length of the usable vectors, of several the smallest; 0 where there is none."""
    first = rows.filter(usable(F.col(vector))).groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), "width").first()
    return first.width if first else 0


def pack(x: np.ndarray) -> pa.Array:
    """Rows of whole numbers as bytes, of the smallest type that holds the row: equal rows are equal bytes."""
    top = np.maximum(x.max(1, initial=0), -(x.min(1, initial=0) + 1))
    out = np.empty(len(x), object)
    wide = top > np.iinfo(np.int16).max
    for mask, kind in ((~wide, TYPES[0]), (wide, TYPES[1])):
        at = np.flatnonzero(mask)
        out[at] = [r.tobytes() for r in np.ascontiguousarray(x[at], kind)] if len(at) else []
    return pa.array(out.tolist(), pa.binary())


def unpack(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), width), np.int64)
    size = np.array([len(r) for r in rows], np.int64)
    for kind in TYPES:
        at = np.flatnonzero(size == width * kind.itemsize)
        if len(at):
            out[at] = np.frombuffer(b"".join(rows[i] for i in at), kind).reshape(-1, width)
    return out


def gridded(rows: DataFrame, vector: str, width: int) -> DataFrame:
    """Rows whose vector is usable and of this width, with x (bytes, see pack) in its place. All other columns have to be of types that Arrow takes."""
    rest = [c for c in rows.columns if c != vector]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.floor(SCALE * c).astype(np.int64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([*(batch.column(r) for r in rest), pack(x)], names=[*rest, "x"])

    fit = rows.filter(usable(F.col(vector)) & (F.size(vector) == width))
    return cluster.bounded_batches(fit).mapInArrow(run, f"{fields}, x binary")
