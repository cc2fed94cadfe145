"""A content-addressed store of token ids.

Rolling hashes cut each document's ids into chunks, equal chunks are stored once under their
SHA-256 address, a recipe lists a document's chunks, and Merkle roots over recipes verify
reconstruction.

    <store>/data/kind=0    recipes as they were made
    <store>/data/kind=1    chunks: address, ids as little-endian integers of `width` bytes
    <store>/recipes        one file per range of doc_id, ascending: shard, rank, doc_id,
                           addresses, counts, local_start, root
    <store>/manifest       one row per shard: documents, ids, Merkle root
    <store>/root           one row: shards, documents, ids, root over the shards' roots in order
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm import cluster, tokens
from colloquy.llm import textvec as tv

LEAST, MEAN, MOST, WINDOW = 32, 256, 1024, 8
SEEN = 150_000
FAN_OUT = 1024


def address(payload: bytes) -> bytes:
    return hashlib.sha256(payload).digest()[:16]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256 over the leaves; a single node moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(level) & ~1 :]
    return level[0]


def cuts(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Chunk ends of every document, relative to its start.

    A chunk ends after an id where the hash of the last WINDOW ids has its low bits zero, so cuts
    depend on content alone and find each other again after an insertion; LEAST and MOST bound it.
    """
    p = tv.prefix(tv.mix(ids.astype(np.uint64), 3), tv._Q)
    at = np.arange(WINDOW, len(ids) + 1)
    ends = at[tv.mix(tv.spans(p, at - WINDOW, at, tv._Q), 9) % np.uint64(MEAN) == 0] if len(at) else at
    lo, hi = np.searchsorted(ends, bounds[:-1], side="right"), np.searchsorted(ends, bounds[1:], side="left")
    ends = ends.tolist()
    out = []
    for a, b, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), lo.tolist(), hi.tolist(), strict=True):
        mine, last = [], a
        for e in [*ends[i:j], b]:
            if e - last < LEAST and e < b:
                continue
            while e - last > MOST:
                last += MOST
                mine.append(last - a)
            if e > last:
                mine.append(e - a)
                last = e
        out.append(mine)
    return out


def write(docs: DataFrame, tokenizer: str, store: str, end_id: int = 2, text: str = "text") -> None:
    """Encode every text of docs (doc_id, text), append end_id, and write the store.

    A null or empty text is the end id alone. Repeated rows and equal doc_ids get a recipe each
    (equal doc_ids in any order); a null doc_id comes first. An empty table gives an empty store.
    A task holds a slice of texts at a time; chunks that a task has written before, among the
    last SEEN, are not sent again, and those that several tasks send are reduced to one by address.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer)
        width = np.dtype("<u2" if encode.dtype == np.uint16 and end_id < 1 << 16 else "<u4")
        part, row, seen = TaskContext.get().partitionId(), 0, {}
        for batch in tv.slices(batches, "text", tokens.SLICE_BYTES):
            ids, bounds = encode(batch.column("text"), end_id)
            ids = ids.astype(width)
            chunks, recipes = [], []
            for doc_id, a, ends in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), cuts(ids, bounds), strict=True):
                addresses, counts, last = [], [], 0
                for e in ends:
                    payload = ids[a + last : a + e].tobytes()
                    key = address(payload)
                    addresses.append(key)
                    counts.append(e - last)
                    if key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen[key] = True
                        chunks.append((key, payload))
                    last = e
                recipes.append((part.to_bytes(8, "big") + row.to_bytes(8, "big"), doc_id, b"".join(addresses), np.array(counts, "<u4").tobytes()))
                row += 1
            n, m = len(recipes), len(chunks)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * n + [1] * m, pa.int32()),
                    pa.array([r[0] for r in recipes] + [c[0] for c in chunks], pa.binary()),
                    pa.array([r[1] for r in recipes] + [None] * m, pa.int64()),
                    pa.array([r[2] for r in recipes] + [c[1] for c in chunks], pa.binary()),
                    pa.array([r[3] for r in recipes] + [width.itemsize.to_bytes(1, "little")] * m, pa.binary()),
                ],
                names=["kind", "key", "doc_id", "body", "extra"],
            )

    rows = cluster.bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = rows.mapInArrow(run, "kind int, key binary, doc_id long, body binary, extra binary")
    once = made.groupBy("kind", "key").agg(*(F.first(c).alias(c) for c in ("doc_id", "body", "extra")))
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{store}/data")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rank, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            counts = [np.frombuffer(x, "<u4") for x in batch.column("extra").to_pylist()]
            totals = np.array([int(c.sum()) for c in counts], np.int64)
            roots = [merkle([x[i : i + 16] for i in range(0, len(x), 16)]) for x in batch.column("body").to_pylist()]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * n, pa.int32()),
                    pa.array(range(rank, rank + n), pa.int64()),
                    batch.column("doc_id"),
                    batch.column("body"),
                    batch.column("extra"),
                    pa.array(totals),
                    pa.array(start + np.cumsum(totals) - totals),
                    pa.array(roots, pa.binary()),
                ],
                names=["shard", "rank", "doc_id", "addresses", "counts", "n_tokens", "local_start", "root"],
            )
            rank, start = rank + n, start + int(totals.sum())

    schema = "shard int, rank long, doc_id long, addresses binary, counts binary, n_tokens long, local_start long, root binary"
    recipes = spark.read.schema("kind int, key binary, doc_id long, body binary, extra binary").parquet(f"{store}/data").filter("kind = 0")
    ordered = recipes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "key").sortWithinPartitions("doc_id", "key")
    ordered.mapInArrow(shards, schema).write.parquet(f"{store}/recipes")
    done = spark.read.schema(schema).parquet(f"{store}/recipes")
    shard_roots(done).write.parquet(f"{store}/manifest")
    whole(spark.read.schema(SHARD).parquet(f"{store}/manifest")).write.parquet(f"{store}/root")


def shard_roots(recipes: DataFrame) -> DataFrame:
    """Per shard: its documents, ids and Merkle root. Documents' roots are hashed in rank order in blocks of FAN_OUT, blocks' hashes in order into the shard's root."""

    def over(order: str, root: str) -> Column:
        return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, root))), lambda x: F.hex(x[root])), ""), 256)

    leaves = recipes.select("shard", F.floor(F.col("rank") / FAN_OUT).alias("block"), "rank", "root", "n_tokens")
    blocks = leaves.groupBy("shard", "block").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("n_tokens"), F.unhex(over("rank", "root")).alias("root"))
    return blocks.groupBy("shard").agg(F.sum("n").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), over("block", "root").alias("root"))


SHARD = "shard int, n_docs long, n_tokens long, root string"


def whole(manifest: DataFrame) -> DataFrame:
    """One row of a manifest: its shards, documents, ids and the root over all shards, of which there are as many as partitions."""
    order = F.transform(F.sort_array(F.collect_list(F.struct("shard", "n_docs", "n_tokens", "root"))), lambda x: F.concat_ws(":", x["shard"], x["n_docs"], x["n_tokens"], x["root"]))
    return manifest.agg(F.count("*").alias("n_shards"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.sha2(F.array_join(order, "\n"), 256).alias("root"))


@lru_cache(4096)
def _zeros(n: int) -> tuple[bytes, int]:
    z = bytes(n)
    return z, zlib.crc32(z, 0)


def join_crc(head: int, tail: int, tail_bytes: int) -> int:
    """CRC-32 of a concatenation from the parts' own."""
    z, base = _zeros(tail_bytes)
    return zlib.crc32(z, head) ^ base ^ tail


RECIPE = "shard int, rank long, doc_id long, addresses binary, counts binary, n_tokens long, local_start long, root binary"
CHUNK = "kind int, key binary, body binary, extra binary"


def _links(recipes: DataFrame) -> DataFrame:
    """One row per chunk of each recipe."""
    n = F.length("addresses") / 16
    at = F.posexplode(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>")))
    return recipes.select("shard", "rank", "addresses", at.alias("pos", "i")).select("shard", "rank", "pos", F.substring("addresses", F.col("i") * 16 + 1, F.lit(16)).alias("key"))


def _verified(spark: SparkSession, store: str) -> DataFrame:
    """The recipes, after the manifest is held against the root of the store, and their roots against the manifest, both ways: a shard without recipes is wrong too."""
    manifest = spark.read.schema(SHARD).parquet(f"{store}/manifest")
    root = spark.read.schema("n_shards long, n_docs long, n_tokens long, root string").parquet(f"{store}/root").collect()
    if [tuple(r) for r in root] != [tuple(whole(manifest).first())]:
        raise ValueError(f"the manifest of {store} does not match its root")
    recipes = spark.read.schema(RECIPE).parquet(f"{store}/recipes")
    found = shard_roots(recipes).withColumn("side", F.lit(1)).unionByName(manifest.withColumn("side", F.lit(-1)))
    wrong = found.groupBy("shard", "n_docs", "n_tokens", "root").agg(F.sum("side").alias("side")).filter("side <> 0").select("shard").distinct().count()
    if wrong:
        raise ValueError(f"{wrong} shards of {store} do not match the manifest")
    return recipes


def _check_chunks(width_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crc, out = [], [], []
            for key, body, extra in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist(), batch.column("extra").to_pylist(), strict=True):
                if address(body) != key:
                    raise ValueError("a chunk does not match its address")
                ids = np.frombuffer(body, f"<u{extra[0]}").astype("<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
                out.append(ids.tobytes() if width_ids else None)
            arrays = [batch.column("key"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())] + ([pa.array(out, pa.binary())] if width_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "n", "crc", "ids"][: len(arrays)])

    return run


def digest(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    Chunks are read back, held against their addresses and summed up once each; a document's
    checksum comes from those of its chunks in the recipe's order, and its recipe from the
    manifest's root. A missing or changed chunk, recipe or shard raises an error.
    """
    recipes = _verified(spark, store)
    chunks = spark.read.schema(CHUNK).parquet(f"{store}/data").filter("kind = 1").select("key", "body", "extra").mapInArrow(_check_chunks(False), "key binary, n long, crc long")
    parts = _links(recipes).join(chunks, "key", "left").groupBy("shard", "rank").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "crc"))).alias("parts"))
    base = spark.read.schema(SHARD).parquet(f"{store}/manifest").select("shard", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    shape = recipes.select("shard", "rank", "doc_id", "n_tokens", "local_start", "addresses", "root").join(parts, ["shard", "rank"], "left").join(base, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for total, addresses, root, parts in zip(*(batch.column(c).to_pylist() for c in ("n_tokens", "addresses", "root", "parts")), strict=True):
                crc, n = 0, 0
                for p in parts or []:
                    if p["n"] is None:
                        raise ValueError("a chunk of a recipe is missing")
                    crc = join_crc(crc, p["crc"], 4 * p["n"])
                    n += p["n"]
                if n != total or merkle([addresses[i : i + 16] for i in range(0, len(addresses), 16)]) != root:
                    raise ValueError("a recipe does not match its chunks")
                crcs.append(crc)
            start = pa.array(np.array(batch.column("base").to_pylist(), np.int64) + np.array(batch.column("local_start").to_pylist(), np.int64)) if batch.num_rows else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), start, batch.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shape.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _check_recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for addresses, root in zip(batch.column("addresses").to_pylist(), batch.column("root").to_pylist(), strict=True):
            if merkle([addresses[i : i + 16] for i in range(0, len(addresses), 16)]) != root:
                raise ValueError("a recipe does not match its root")
        yield batch


def read(spark: SparkSession, store: str) -> DataFrame:
    """doc_id and the document's ids as little-endian 32-bit integers, put together from the chunks; what is missing or changed raises an error, as in digest."""
    recipes = _verified(spark, store).mapInArrow(_check_recipes, RECIPE)
    chunks = spark.read.schema(CHUNK).parquet(f"{store}/data").filter("kind = 1").select("key", "body", "extra").mapInArrow(_check_chunks(True), "key binary, n long, crc long, ids binary")
    whole = _links(recipes).join(chunks, "key", "left").groupBy("shard", "rank").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, F.coalesce(p["ids"], F.raise_error(F.lit("a chunk of a recipe is missing")).cast("binary"))))
    return recipes.select("shard", "rank", "doc_id").join(whole, ["shard", "rank"]).select("doc_id", joined.alias("ids"))
