import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import cas, cluster, tokens

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 40000, 20000)
    moved = np.concatenate([rng.integers(0, 40000, 77), ids])
    a = set(np.array(cas.cuts(ids, np.array([0, len(ids)]))[0]).tolist())
    b = {x - 77 for x in cas.cuts(moved, np.array([0, len(moved)]))[0]}
    assert len(a & b) > 0.9 * len(a)
    sizes = np.diff([0, *sorted(a)])
    assert sizes.max() <= cas.MOST and sizes[:-1].min() >= cas.LEAST and sizes.sum() == len(ids)


def test_joined_checksums():
    a, b = b"abc" * 10, b"defg" * 7
    assert cas.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_round_trip(spark):
    long = " ".join(f"word{i * i % 977}" for i in range(5000))
    texts = [None, "", "a b", long, long, "x " + long, long + " y", "a b"]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(7, "a b", 0), (None, "null", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    store = cluster.shared_dir(spark, "store")
    cas.write(docs, WORD, store)
    enc = tokens.encoder(WORD).tokenizer
    want = {i: np.array(enc.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for i, t, _ in rows}
    got = cas.read(spark, store).collect()
    assert len(got) == len(rows) and all(bytes(r.ids) == want[r.doc_id] for r in got)
    rows_out = cas.digest(spark, store).orderBy("start").collect()
    at = 0
    for r in rows_out:
        assert (r.start, r.n_tokens * 4, r.ids_crc32) == (at, len(want[r.doc_id]), zlib.crc32(want[r.doc_id]))
        at += r.n_tokens
    assert [r.doc_id for r in rows_out] == [None, *range(7), 7, 7]
    chunks = spark.read.parquet(f"{store}/data").filter("kind = 1")
    assert chunks.count() == chunks.select("key").distinct().count()
    assert sum(len(r.body) // 2 for r in chunks.collect()) < 0.4 * at
    spark.read.parquet(f"{store}/manifest").selectExpr("shard", "n_docs", "n_tokens + 1 as n_tokens", "root").write.parquet(f"{store}/other")
    spark.read.parquet(f"{store}/other").write.mode("overwrite").parquet(f"{store}/manifest")
    with pytest.raises(ValueError, match="manifest"):
        cas.digest(spark, store)
    empty = cluster.shared_dir(spark, "store")
    cas.write(docs.limit(0), WORD, empty)
    assert cas.digest(spark, empty).count() == 0


def test_a_lost_recipe_file_is_seen(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(60)], "doc_id long, text string")
    store = cluster.shared_dir(spark, "store")
    cas.write(docs, WORD, store)
    files = {r.f: r.n for r in spark.read.parquet(f"{store}/recipes").groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()}
    assert cas.digest(spark, store).count() == 60 and len(files) > 1
    os.remove(min(files).removeprefix("file://"))
    for back in (cas.digest, cas.read):
        with pytest.raises(ValueError, match="1 shards"):
            back(spark, store)


@pytest.mark.parametrize("kind,spoil,error", [
    ("data/kind=1", "remove", "chunk of a recipe is missing"), ("data/kind=1", "change", "does not match its address"), ("recipes", "change", "does not match|is missing"),
    ("manifest", "remove", "does not match its root"), ("root", "remove", "does not match its root"),
])
def test_what_is_lost_or_changed_is_seen(spark, kind, spoil, error):
    docs = spark.createDataFrame([(i, f"text {i} of {i * 7 % 11} " * (5 * i + 1)) for i in range(40)], "doc_id long, text string")
    store = cluster.shared_dir(spark, "store")
    cas.write(docs, WORD, store)
    folder = f"{store}/{kind}".removeprefix("file://")
    files = sorted((os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")), key=os.path.getsize)
    old = spark.read.parquet(files[-1])
    if spoil == "change":
        column = {"data/kind=1": "body", "recipes": "addresses"}[kind]
        new = old.withColumn(column, F.concat(F.expr(f"substring({column}, 3)"), F.expr(f"substring({column}, 1, 2)"))).collect()
    for f in files if spoil == "remove" else files[-1:]:
        os.remove(f)
    if spoil == "change":
        spark.createDataFrame(new, old.schema).write.mode("append").parquet(f"{store}/{kind}")
    spark.catalog.clearCache()
    for back in (cas.digest, cas.read):
        with pytest.raises(Exception, match=error):
            back(spark, store).collect()
