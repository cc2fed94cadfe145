"""Writers: manifests, exports and appends (changes in place: merge; swaps and snapshots: store). Spark's commit makes each write whole or absent."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_manifest(df: DataFrame, path: str, partition: str, version: str) -> DataFrame:
    """Write df by partition, then a manifest of rows and an order-free digest per partition; returns the manifest."""
    df.write.mode("overwrite").partitionBy(partition).parquet(f"{path}/data")
    body = F.xxhash64(*[c for c in df.columns if c != partition]).cast("decimal(38,0)")
    made = df.sparkSession.read.parquet(f"{path}/data").groupBy(partition).agg(F.count("*").alias("rows"), F.sum(body).alias("digest")).withColumn("version", F.lit(version))
    made.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def is_complete(spark: SparkSession, path: str, version: str) -> bool:
    """Whether the manifest exists, has this version and fits the data, by rows and digest of each part; if so a run can be skipped."""
    from pyspark.errors import AnalysisException

    try:
        manifest = spark.read.parquet(f"{path}/manifest")
        data = spark.read.parquet(f"{path}/data")
    except AnalysisException:
        return False
    partition = next(c for c in manifest.columns if c not in ("rows", "digest", "version"))
    body = F.xxhash64(*[c for c in data.columns if c != partition]).cast("decimal(38,0)")
    found = data.groupBy(partition).agg(F.count("*").alias("rows"), F.sum(body).alias("digest")).withColumn("version", F.lit(version))
    columns = [F.col(partition).cast("string"), "rows", F.col("digest").cast("decimal(38,0)"), "version"]
    left, right = manifest.select(*columns), found.select(*columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


#: The kinds of analysis records, each a log of its own.
RECORDS = ("query_analysis", "retrieval_trace", "rerank_scores", "evidence", "context", "agent_steps", "answers", "verdicts")


def append_records(df: DataFrame, folder: str, kind: str) -> None:
    """Rows go to the end of the log of their kind, as one JSON object a line; a kind that is none of RECORDS is an error."""
    if kind not in RECORDS:
        raise ValueError(f"unknown kind of record {kind}")
    df.write.mode("append").json(f"{folder}/{kind}")


def export_jsonl(df: DataFrame, path: str, key: str = "id") -> None:
    """One object a line; a missing id becomes the hash of the row."""
    df.withColumn(key, F.coalesce(F.col(key).cast("string"), F.sha2(F.to_json(F.struct(*df.columns)), 256))).write.mode("overwrite").json(path)


def latest_gapless(snapshots: DataFrame, key: str = "number") -> DataFrame:
    """The highest number of 1, 2, 3 ... without a gap, and whether later ones exist."""
    numbers = snapshots.select(key).filter(F.col(key) > 0).distinct()
    # a gap begins after a number whose next one is missing; the first gap ends the prefix
    ends = numbers.join(numbers.select((F.col(key) - 1).alias(key)), key, "left_anti")
    first = numbers.agg(F.min(key).alias("_least"), F.max(key).alias("_most")).crossJoin(ends.agg(F.min(key).alias("_end")))
    highest = F.when(F.col("_least") == 1, F.col("_end")).otherwise(F.lit(0))
    return first.select(F.coalesce(highest, F.lit(0)).alias("highest"), F.when(F.coalesce("_most", F.lit(0)) > F.coalesce(highest, F.lit(0)), 1).otherwise(0).alias("after_gap"))


def usage_totals(usage: DataFrame) -> DataFrame:
    """Token use by dataset, stage and label, with subtotals and a grand total (nulls)."""
    return usage.rollup("dataset", "stage", "label").agg(F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens", "elapsed_s")))


#: Name parts of settings that are masked.
SECRET = re.compile(r"key|token|secret|password|credential", re.I)


def masked(settings: dict[str, str]) -> dict[str, str]:
    return {k: "***" if SECRET.search(k) and v else v for k, v in settings.items()}


def write_evaluation(rows: DataFrame, path: str) -> None:
    """Evaluated rows as CSV with a header, also where there are none."""
    (rows.coalesce(1) if rows.isEmpty() else rows).write.mode("overwrite").option("header", True).csv(path)


def traces(stages: DataFrame, request: str, order: str, stage: str, names: str, skipped: str) -> DataFrame:
    """request, trace: one text of numbered stages per request, with the names that each kept or why it was skipped."""
    line = F.concat(F.col(order).cast("string"), F.lit(". "), F.col(stage), F.lit(": "), F.when(F.col(skipped).isNotNull(), F.concat(F.lit("skipped ("), F.col(skipped), F.lit(")"))).otherwise(F.coalesce(names, F.lit("-"))))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"])
    return stages.groupBy(request).agg(F.array_join(lines, "\n").alias("trace"))


def export_traces(stages: DataFrame, path: str, request: str, order: str, stage: str, names: str, skipped: str) -> None:
    """One JSON object per request with its stages in order, and the text of traces."""
    grouped = stages.groupBy(request).agg(F.sort_array(F.collect_list(F.struct(order, stage, names, skipped))).alias("stages"))
    grouped.join(traces(stages, request, order, stage, names, skipped), request).write.mode("overwrite").json(path)


def write_questions(rows: DataFrame, path: str, question: str, order: list[str]) -> DataFrame:
    """Rows as CSV with LF and UTF-8, a folder of one file for each question, and question, rows, sha256 of each: the digest of its lines in the order given, joined by LF. A question is one group, as it is one file."""
    columns = [c for c in rows.columns if c != question]
    rows.repartition(question).sortWithinPartitions(question, *order).write.mode("overwrite").partitionBy(question).option("header", True).option("lineSep", "\n").csv(path)
    line = F.to_csv(F.struct(*columns))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"])
    return rows.groupBy(question).agg(F.count("*").alias("rows"), F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))
