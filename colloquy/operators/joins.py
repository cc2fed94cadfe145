"""Prioritised lookups, mappings to gold and resume filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(rows: DataFrame, texts: DataFrame, key: str, text: str, most: int = 3000) -> DataFrame:
    """Left join of texts by id, truncated; blank texts are skipped."""
    from colloquy.functions.text import truncated

    some = texts.filter(F.trim(F.coalesce(text, F.lit(""))) != "").select(key, truncated(F.col(text), most).alias(text))
    return rows.join(some, key, "left")


def first_match(asked: DataFrame, key: str, steps: list[tuple[DataFrame, list[str]]], value: str) -> DataFrame:
    """value of the first step whose equality join finds one (the smallest of several), with the step's number; null if none does.

    A table has one row for what is joined on before it is joined, so a common one does not multiply the rows that ask."""
    found = None
    for n, (table, on) in enumerate(steps, 1):
        least = table.groupBy(*on).agg(F.min(value).alias(value))
        hit = asked.join(least, on).groupBy(key).agg(F.min(value).alias(value)).withColumn("step", F.lit(n))
        found = hit if found is None else found.union(hit)
    best = found.withColumn("_b", F.min("step").over(Window.partitionBy(key))).filter("step = _b").drop("_b")
    return asked.select(key).distinct().join(best, key, "left")


def category_back(rows: DataFrame, labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    return rows.join(labels.select(*keys, label), keys, "left").withColumn(label, F.coalesce(label, F.lit("Unknown")))


def gold_chunks(evidence: DataFrame, kept: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Gold turns to the chunk of n kept turns that holds them; kept: keys, pos."""
    return evidence.join(kept, keys).withColumn("chunk", F.floor(F.col("pos") / n))


def id_sets(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Ids of one side only, with the side."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return e.join(a, key, "left_anti").withColumn("side", F.lit("missing")).union(a.join(e, key, "left_anti").withColumn("side", F.lit("extra")))


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def with_placeholders(expected: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Every expected key, with nulls where there is no row."""
    return expected.select(key).distinct().join(rows, key, "left")


def largest_cluster(answers: DataFrame, key: str, norm: Column, run: str) -> DataFrame:
    """Per key the answer that most runs share; a three-way split falls to the first run."""
    g = answers.withColumn("_norm", norm).groupBy(key, "_norm").agg(F.count("*").alias("support"), F.min(run).alias("rep"))
    w = Window.partitionBy(key).orderBy(F.desc("support"), "rep")
    return g.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(key, "rep", "support")


def verdict_pick(answers: DataFrame, key: str, verdict: str, support: str, run: str) -> DataFrame:
    """Per key the answer with the best verdict, then most support, then the first run; if no verdict is positive, the first run."""
    w = Window.partitionBy(key)
    best = F.row_number().over(w.orderBy(F.desc(verdict), F.desc(support), run))
    first = F.row_number().over(w.orderBy(run))
    ranked = answers.withColumn("_any", F.max(verdict).over(w)).withColumn("_b", best).withColumn("_f", first)
    return ranked.filter(F.when(F.col("_any") > 0, F.col("_b") == 1).otherwise(F.col("_f") == 1)).drop("_any", "_b", "_f")


def agent_statistics(records: DataFrame, group: str, fallback: str, kept: str, added: str) -> DataFrame:
    """Share of fallbacks in percent and mean numbers of ids kept and added."""
    return records.groupBy(group).agg(
        F.count("*").alias("n"), F.round(100 * F.avg(F.col(fallback).isNotNull().cast("int")), 2).alias("fallback_pct"), F.round(F.avg(F.size(kept)), 4).alias("mean_kept"), F.round(F.avg(F.size(added)), 4).alias("mean_added")
    )


def needs_rerun(rows: DataFrame, failed: Column, context: str) -> DataFrame:
    """Rows that failed, or whose context is blank or missing."""
    return rows.filter(F.coalesce(failed, F.lit(False)) | (F.trim(F.coalesce(context, F.lit(""))) == ""))


def first_question(rows: DataFrame, key: str, order: str, question: str, dates: list[str], missing: str) -> DataFrame:
    """Per key its first question and a date: the first value of the first of the date columns that has one."""
    found = [F.min_by(d, F.when(F.col(d).isNotNull(), F.col(order))) for d in dates]
    return rows.groupBy(key).agg(F.min_by(question, order).alias(question), F.coalesce(*found, F.lit(missing)).alias("date"))


def planned(datasets: DataFrame, place: str, name: str, child: str, places: list[int], without: list[str]) -> DataFrame:
    """child, datasets: names at the given places, in order, without those of excluded children."""
    kept = datasets.filter(F.col(place).isin(places) & ~F.col(child).isin(without))
    return kept.groupBy(child).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, name))), lambda x: x[name]), ",").alias("datasets"))
