"""Why a question failed: stage differences, failure types, flags and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stage_diff(stages: DataFrame, keys: list[str], order: str, names: str) -> DataFrame:
    """Per branch, what each stage added and removed against the one before it."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.coalesce(F.lag(names).over(w), F.array().cast("array<string>"))
    return stages.withColumn("_before", before).select(
        *keys, order, F.array_sort(F.array_except(names, "_before")).alias("added"), F.array_sort(F.array_except("_before", names)).alias("removed")
    )


def failure_type(exception: Column, seeds: Column, evidence: Column, best_score: Column, on_topic: Column, least: float) -> Column:
    """The first that holds."""
    return (
        F.when(exception.isNotNull(), "exception")
        .when(seeds == 0, "empty_seed")
        .when(evidence == 0, "empty_evidence")
        .when(best_score < least, "low_confidence")
        .when(~on_topic, "off_topic")
        .otherwise("judge_or_answer")
    )


def anomaly_flags(flags: dict[str, Column]) -> Column:
    """All names whose condition holds."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())))


def bridge(correct: Column, gold_found: Column) -> Column:
    return F.when(correct, "not_applicable").when(~gold_found, "retrieval_failure").otherwise("answer_construction_failure")


def latest_holding(copies: DataFrame, gold: DataFrame, key: str, order: str, prov: str) -> DataFrame:
    """Of each key the latest copy, and how many gold summaries its provenance holds."""
    last = copies.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1")
    held = last.select(key, F.explode(prov).alias("summary_id")).join(gold.select("summary_id").distinct(), "summary_id", "left_semi").groupBy(key).agg(F.count_distinct("summary_id").alias("n_gold"))
    return last.select(key).join(held, key, "left").select(key, F.coalesce("n_gold", F.lit(0)).alias("n_gold"))


def failing_requests(log: DataFrame, start: str, failed: list[str], target: Column) -> DataFrame:
    """Failing events of the requests whose start event meets the target."""
    wanted = log.filter((F.col("event") == start) & target).select("request_id").distinct()
    return log.filter(F.col("event").isin(failed)).join(wanted, "request_id", "left_semi")


def first_failing_step(checks: dict[str, Column]) -> Column:
    """Name of the first check that does not hold, else ok."""
    out = None
    for name, ok in checks.items():
        out = F.when(~ok, name) if out is None else out.when(~ok, name)
    return out.otherwise("ok")


def ingest_verdict(entities: Column, added: Column, updated: Column) -> Column:
    return F.when(entities == 0, "zero_entities").when(added + updated == 0, "zero_delta").otherwise("ok")
