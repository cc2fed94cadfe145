"""Judging in portions that are committed one by one, so that a job that was stopped goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.merge import exists

VERDICT = "verdict double, run int"


def verdicts(spark: SparkSession, path: str, key: str, kind: str = "long") -> DataFrame:
    """key, verdict, run of all that is committed; of several verdicts of a key the first run's counts."""
    rows = spark.read.schema(f"{key} {kind}, {VERDICT}").parquet(path)
    return rows.groupBy(key).agg(F.min(F.struct("run", "verdict")).alias("v")).select(key, "v.verdict", "v.run")


def judge(rows: DataFrame, path: str, key: str, judged: Callable[[DataFrame], DataFrame], portions: int = 100, portion: Column | None = None, needed: tuple[str, ...] = ("question", "answer"), stop_after: int | None = None) -> DataFrame:
    """rows with their verdict, which `judged` adds to those that have none: once each, portion by portion.

    A verdict of 0 or 1 that a row brings with it stays; a row with a blank among `needed` is not judged and its verdict is null. Each portion
    is one append below path that is there as a whole or not at all; what is there already is carried on and not judged again, so
    after a failure the same call does what is left. stop_after: so many portions in this call. Keys are unique and not null.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    given = F.col("verdict").isin(0, 1) if "verdict" in rows.columns else F.lit(False)
    blank = F.lit(False)
    for c in needed:
        blank = blank | (F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    where = portion if portion is not None else F.pmod(F.xxhash64(key), F.lit(portions))
    open_ = rows.filter(~F.coalesce(given, F.lit(False)) & ~blank & F.col(key).isNotNull()).withColumn("_portion", where)
    run, done = 0, None
    if exists(spark, path):
        done = verdicts(spark, path, key, kind)
        run = (done.agg(F.max("run")).first()[0] or 0) + 1
        open_ = open_.join(done.select(key), key, "left_anti")
    left = sorted(r[0] for r in open_.select("_portion").distinct().collect())  # at most `portions` numbers
    for p in left[:stop_after]:
        part = open_.filter(F.col("_portion") == p).drop("_portion", "verdict")
        judged(part).select(key, F.col("verdict").cast("double").alias("verdict"), F.lit(run).alias("run")).write.mode("append").parquet(path)
    made = verdicts(spark, path, key, kind).withColumnRenamed("verdict", "_new") if exists(spark, path) else None
    carried = F.when(given, F.col("verdict").cast("double")) if "verdict" in rows.columns else F.lit(None).cast("double")
    base = rows.withColumn("verdict", carried)
    if made is None:
        return base
    return base.join(made.drop("run"), key, "left").withColumn("verdict", F.coalesce("verdict", "_new")).drop("_new")
