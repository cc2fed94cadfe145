"""Provenance events, merges and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENT = "struct<ts:int,summary_id:string,session_id:string,message_id:string,dialogue_datetime:string>"


def events_from_flat(rows: DataFrame, ids: str, dates: str) -> DataFrame:
    """prov from parallel arrays of summary ids and datetimes: positional ts; session and message are the parts of an id at its first colon."""
    event = F.transform(
        F.arrays_zip(F.col(ids).alias("a"), F.col(dates).alias("b")),
        lambda x, i: F.named_struct(
            F.lit("ts"), i, F.lit("summary_id"), x["a"].cast("string"), F.lit("session_id"), F.substring_index(x["a"], ":", 1),
            F.lit("message_id"), F.regexp_replace(x["a"], "^[^:]*:?", ""), F.lit("dialogue_datetime"), x["b"],
        ),
    )
    return rows.withColumn("prov", event)


def explode_events(rows: DataFrame, key: str, prov: str = "prov") -> DataFrame:
    """key and one row per event, newest ts first in pos order."""
    return rows.select(key, F.posexplode(prov).alias("pos", "_e")).select(key, "pos", "_e.*")


def merge_events(events: DataFrame, key: str, order: str) -> DataFrame:
    """Union of events by (session, message, summary): the newest by `order` wins; ordered by ts within key as n."""
    last = Window.partitionBy(key, "session_id", "message_id", "summary_id").orderBy(F.desc(order))
    kept = events.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("ts", "summary_id")))


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def richest(rows: DataFrame, key: str, prov: str, position: str) -> DataFrame:
    """Of copies of a key the first with most events."""
    return latest(rows, [key], F.desc(F.size(prov)), position)


def merge_pairs(rows: DataFrame, keys: list[str], description: str, order: str, mark: str = "; ") -> DataFrame:
    """One row per ordered pair: descriptions in order, each appended unless the text so far already holds it; exact repeats skipped."""
    said = F.transform(F.sort_array(F.collect_list(F.struct(order, description))), lambda x: x[description])
    joined = F.aggregate(said, F.lit(""), lambda acc, d: F.when(acc == "", d).when(F.contains(acc, d), acc).otherwise(F.concat(acc, F.lit(mark), d)))
    return rows.groupBy(*keys).agg(joined.alias(description), F.count("*").alias("n_merged"))


def expand_to_summaries(prov: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """Entities or relations to the summaries that their events name."""
    return explode_events(prov, key).join(summaries, "summary_id").select(key, "summary_id", "ts", "text")


def merge_upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new replaces rows of current with the same keys; the rest of both stays."""
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new)
