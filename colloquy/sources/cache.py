"""Caches that may be missing or broken: both read as empty, and a write replaces the whole."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from colloquy.sources.store import Files


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cached rows, or none where the cache is missing or a file of it cannot be read."""
    empty = spark.createDataFrame([], schema)
    if not Files(spark).exists(path):
        return empty
    try:
        rows = spark.read.schema(schema).parquet(path)
        rows.write.format("noop").mode("overwrite").save()  # every file is read once
        return rows
    except (PySparkException, Py4JJavaError):
        return empty


def save(rows: DataFrame, path: str) -> None:
    """A failed write raises; Spark's commit keeps a part from showing."""
    rows.write.mode("overwrite").parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    Files(spark).remove(path)
