"""The opN queries, the pipeline query and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import cas, chat, cluster, decontam, embed_dedup, hmm, jaccard, labelled, negatives, packing, quality, secrets, substring, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = cluster.shared_dir(spark, "store")
    cas.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), store)
    return cas.digest(spark, store)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link(table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (labelled.bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (labelled.bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least_item=1)
    return found.select("doc_id", "contaminated", F.array_distinct("found.item_id").alias("item_ids"), F.array_max("found.share").alias("best_share"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(negatives.relabelled(table(spark, sf_dir, "embeddings")))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"), secrets.Ledger(spark, cluster.shared_dir(spark, "ledger")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_content_store, op3_embedding_dedup, op4_quality, op5_substring_dedup, op6_ngram_jaccard, op7_toxicity, op8_hidden_markov, op9_perspectives, op10_decontamination, op11_hard_negatives, op12_secrets, op13_whitening)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op9_perspectives": chat.SQL, "op11_hard_negatives": negatives.SQL, "op12_secrets": secrets.SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
