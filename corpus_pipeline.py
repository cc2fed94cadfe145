"""A corpus pipeline: toxic documents go, one of each group of near-duplicates stays, repeated
passages go, documents with benchmark passages go, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of docs, whatever their
names: doc_id and text are read, n_chars is kept in step with a text that changes, and all others
pass through. In every stage an empty table gives an empty table, a text of any length is taken whole,
and rows are judged by their content, so their order and ties do not matter.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import cluster, decontam, jaccard, packing, substring, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on labels of these documents, scores below 0.5.

    Null and empty texts, and those without a letter, are kept; rows with a null doc_id are scored but
    never learned from; repeated rows are scored each. Without labels of both kinds all documents get the same score: kept, unless all labels are toxic.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a shingle similarity of 0.8, the one with the smallest doc_id.

    Of repeated rows (one doc_id and text) one stays. Null texts, texts without a word and rows with a null doc_id are in no group and all stay.
    """
    return jaccard.representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 50-word windows that an earlier document holds; a document left without a word goes.

    Null and empty texts, and rows with a null doc_id, stay as they are; rows with one doc_id never take each other's words.
    """
    return substring.deduplicate(docs, as_documents=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that overlap with no benchmark item. Null and empty texts overlap with none; rows with a null doc_id are judged like others."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_item=decontam.LEAST_VERBATIM)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every text in sequences of 2048. A null or empty text is its end id; rows with a null doc_id and repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), emit_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: The stages learn, hash and tokenize, which SQL cannot; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cluster.written(stage(spark, docs, sf_dir), name)
    return docs
