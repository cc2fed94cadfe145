"""Packing documents into fixed-length training sequences.

First-fit decreasing over a tournament tree of bin capacities, run independently in
randomised groups of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import cluster, tokens
from colloquy.llm import textvec as tv

GROUP_TOKENS = 4 << 20
#: Pieces in a batch of output.
BATCH = 512
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Free places of bins in a complete binary tree whose inner nodes hold the larger child, so the first bin that fits is found in a walk down."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """The first bin with room for size; takes it."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        tree[at] -= size
        bin_, at = at - self.leaves, at >> 1
        while at:
            best = tree[2 * at] if tree[2 * at] >= tree[2 * at + 1] else tree[2 * at + 1]
            if tree[at] == best:
                break
            tree[at] = best
            at >>= 1
        return bin_


def pack_group(lengths: list[int], capacity: int, least_hole: int = 16) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, bin, offset) of every piece.

    Whole stretches of `capacity` fill bins of their own; the rests go first-fit decreasing.
    Then the emptiest bins are taken apart to fill the holes of `least_hole` or more in others,
    which cuts documents only there. Every position of every document is in exactly one piece.
    """
    out, bins = [], 0
    rests = []
    for doc, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            out.append((doc, k * capacity, capacity, bins, 0))
            bins += 1
        if n % capacity:
            rests.append((n % capacity, doc, whole * capacity))
    if not rests:
        return out
    rests.sort(key=lambda x: (-x[0], x[1]))
    tree = Tournament(len(rests), capacity)
    content: list[list[list[int]]] = []
    for size, doc, start in rests:
        b = tree.first_fit(size)
        while len(content) <= b:
            content.append([])
        content[b].append([doc, start, size])
    free = [capacity - sum(x[2] for x in c) for c in content]
    order = sorted(range(len(content)), key=lambda b: free[b])
    lo, hi = 0, len(order) - 1
    while lo < hi:
        to, source = order[lo], order[hi]
        if free[to] < least_hole:
            lo += 1
            continue
        if not content[source]:
            hi -= 1
            continue
        piece = content[source][-1]
        take = min(piece[2], free[to])
        content[to].append([piece[0], piece[1], take])
        free[to] -= take
        free[source] += take
        piece[1] += take
        piece[2] -= take
        if not piece[2]:
            content[source].pop()
    for c in content:
        if c:
            at = 0
            for doc, start, size in c:
                out.append((doc, start, size, bins, at))
                at += size
            bins += 1
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, group_tokens: int = GROUP_TOKENS, emit_ids: bool = False, text: str = "text") -> DataFrame:
    """Pack every text of docs (doc_id, text) into sequences of `capacity` tokens.

    One shuffle deals documents at random over tasks; a task tokenizes its documents and packs
    groups of about `group_tokens` tokens, so memory is bounded by a group and its longest text.
    Returns SCHEMA (and with emit_ids the piece's ids as little-endian bytes): one row per piece.

    A null or empty text is the end id alone. Repeated rows and equal or null doc_ids are packed
    each on their own. A text of any length is cut over sequences. An empty table gives no rows.
    Other columns of docs are not read.
    """
    schema = SCHEMA + (", ids binary" if emit_ids else "")
    width = np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer)
        part = TaskContext.get().partitionId()
        state = {"next": part << 40}
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids = [x for _, x in held]
            pieces = pack_group([len(x) for x in ids], capacity)
            for at in range(0, len(pieces), BATCH):
                cols: list[list] = [[] for _ in range(8)]
                for doc, start, n, bin_, offset in pieces[at : at + BATCH]:
                    piece = ids[doc][start : start + n].astype(width).tobytes()
                    for c, v in zip(cols, (held[doc][0], start, n, zlib.crc32(piece), len(ids[doc]), state["next"] + bin_, offset, piece), strict=True):
                        c.append(v)
                arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + ([pa.array(cols[7], pa.binary())] if emit_ids else [])
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])
            state["next"] += max((p[3] for p in pieces), default=-1) + 1

        for batch in tv.slices(batches, "text", tokens.SLICE_BYTES):
            ids, bounds = encode(batch.column("text"), end_id)
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                held.append((doc_id, ids[a:b]))
                size += b - a
                if size >= group_tokens:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    rows = cluster.bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.repartition(cluster.partitions(rows)).sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id")
    return dealt.mapInArrow(run, schema)
