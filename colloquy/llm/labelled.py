"""A bounded sample of labelled texts, and the split of rows by their ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import cluster
from colloquy.llm import textvec as tv

#: About how many labelled texts a classifier is fitted on, and bytes of text after which no more are taken.
SAMPLE, SAMPLE_BYTES = 5000, 48 << 20


def bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; 0 for a null id, which has no label."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % modulus, F.lit(0))


def share(rows: DataFrame, key: Column, most: int, n: int) -> DataFrame:
    """About `most` of n rows, and never more than twice as many: those with a small hash of the key, so that tasks pass on only what is used."""
    cut = min(1.0, most / max(1, n))
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int(cut * (1 << 30)))).limit(2 * most)


def chosen(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, text: str = "text") -> DataFrame:
    """doc_id, label, text of about `most` labelled rows for which `learn` holds, by a hash of their ids.

    Texts of any length count; rows are taken in the order of the hash until they hold most_bytes of
    text, the one that reaches it included. The chosen ids are the only thing broadcast (at most twice
    `most`). Null labels and ids are not used; an id with several labels counts by its largest, an id
    with several texts by the one with the smallest hash, whichever row comes first.
    """
    spark = docs.sparkSession
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(learn)
    single = named.groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = share(single, F.col("doc_id"), most, single.count()).collect()
    rows = cluster.bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def of(few: list) -> DataFrame:
        return rows.join(F.broadcast(spark.createDataFrame([tuple(r) for r in few], "doc_id long, label int")), "doc_id")

    sizes = of(ids).groupBy("doc_id").agg(F.max(F.octet_length(F.coalesce("text", F.lit("")))).alias("size")).withColumn("hash", F.xxhash64("doc_id")).collect()
    use, total = set(), 0
    for r in sorted(sizes, key=lambda r: (r.hash, r.doc_id)):
        if total >= most_bytes:
            break
        use.add(r.doc_id)
        total += r.size
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"]
    return of([r for r in ids if r.doc_id in use]).groupBy("doc_id", "label").agg(one.alias("text"))


def sample(rows: DataFrame, encode: Callable[[pa.Array], list[bytes]]) -> list[tuple[bytes, int]]:
    """(encoded text, label) of rows (doc_id, label, text) in the order of ids; texts are encoded where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(encode(batch.column("text")), pa.binary())], names=["doc_id", "label", "code"])

    got = rows.mapInArrow(run, "doc_id long, label int, code binary").toArrow().sort_by("doc_id")
    return list(zip(got.column("code").to_pylist(), got.column("label").to_pylist(), strict=True))


class Adam:
    """Gradient steps with running moments."""

    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, name: str, value, grad):
        if name not in self.m:
            self.m[name], self.v[name] = grad * 0, grad * 0
        self.m[name] = 0.9 * self.m[name] + 0.1 * grad
        self.v[name] = 0.999 * self.v[name] + 0.001 * grad * grad
        m, v = self.m[name] / (1 - 0.9**self.t), self.v[name] / (1 - 0.999**self.t)
        return value - self.rate * m / (v**0.5 + 1e-8)
