"""Evidence blocks and contexts as text, and what is read back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def render_block(items: DataFrame, query: str, at: str, sid: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best items of each query as lines with time, sid and score."""
    ranked = items.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), tie))).filter(F.col("_r") <= k)
    line = F.format_string("  • [%s][sid=%s][score=%.3f]", F.col(at), F.col(sid), F.col(score))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("_r", line.alias("line")))), lambda x: x["line"])
    return ranked.groupBy(query).agg(F.array_join(lines, "\n").alias("block"))


def seed_sids(context: Column) -> Column:
    """Distinct sids of a context in order."""
    return F.array_distinct(F.regexp_extract_all(context, F.lit("\\[sid=([^\\]]+)\\]"), F.lit(1)))


def seed_scores(context: Column) -> Column:
    """Map of sid to score of entries that carry both; the first counts."""
    sids = F.regexp_extract_all(context, F.lit("\\[sid=([^\\]]+)\\]\\[score=([-0-9.]+)\\]"), F.lit(1))
    scores = F.regexp_extract_all(context, F.lit("\\[sid=([^\\]]+)\\]\\[score=([-0-9.]+)\\]"), F.lit(2))
    return F.arrays_zip(sids.alias("sid"), scores.alias("score"))


def render_graph(entities: DataFrame, relations: DataFrame, query: str) -> DataFrame:
    """=== Entities === and === Relationships === sections by rank; a mention time only for dates, events and activities."""
    when = F.when(F.col("type").isin("Date", "Event", "Activity") & F.col("mentioned_at").isNotNull(), F.concat(F.lit(" [mentioned_at: "), "mentioned_at", F.lit("]"))).otherwise("")
    e = entities.groupBy(query).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit("): "), "description", when).alias("l")))), lambda x: x["l"]), "\n").alias("e"))
    r = relations.groupBy(query).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("- "), "label").alias("l")))), lambda x: x["l"]), "\n").alias("r"))
    both = e.join(r, query, "full")
    return both.select(query, F.concat(F.lit("=== Entities ===\n"), F.coalesce("e", F.lit("")), F.lit("\n=== Relationships ===\n"), F.coalesce("r", F.lit(""))).alias("context"))


def append_fetched(contexts: DataFrame, fetched: DataFrame, query: str) -> DataFrame:
    """The context with an additional block of fetched entries (query, n, line)."""
    add = fetched.groupBy(query).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("_more"))
    return contexts.join(add, query, "left").withColumn("context", F.concat("context", F.when(F.col("_more").isNotNull(), F.concat(F.lit("\n=== Additional Evidence ===\n"), "_more")).otherwise(""))).drop("_more")


def append_scores(scores: DataFrame, path: str) -> None:
    """Scores go to the end of a log; each batch appears whole."""
    scores.write.mode("append").option("header", True).csv(path)


def scores_of(spark, path: str, schema, requests: list[str], column: str = "request_id") -> DataFrame:
    """Rows of a score log for the given requests, ids compared as trimmed text."""
    rows = spark.read.schema(schema).option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return rows.withColumn(column, F.trim(column)).filter(F.col(column).isin([r.strip() for r in requests]))


def relation_endpoints(label: Column) -> Column:
    """source, target, description of a label source -> target | description."""
    head, tail = F.split_part(label, F.lit(" | "), F.lit(1)), F.split_part(label, F.lit(" | "), F.lit(2))
    return F.struct(F.split_part(head, F.lit(" -> "), F.lit(1)).alias("source"), F.split_part(head, F.lit(" -> "), F.lit(2)).alias("target"), tail.alias("description"))


def rebuilt(chosen: DataFrame, turns: DataFrame, query: str, pair: bool = True) -> DataFrame:
    """query, block, n: lines of the chosen ids (query, place, sid) in their order, each once; pair: with the other half of an exchange (sid:u and sid:a) in the line of the first of the two.

    turns: sid, at, text. Ids without a turn have no line.
    """
    stem = F.regexp_replace("sid", ":[ua]$", "")
    key = stem if pair else F.col("sid")
    wanted = chosen.select(query, key.alias("_key"), "place").groupBy(query, "_key").agg(F.min("place").alias("place"))
    known = turns.select(F.col("sid"), "at", "text", (stem if pair else F.col("sid")).alias("_key"))
    each = wanted.join(known, "_key").groupBy(query, "_key", "place").agg(F.sort_array(F.collect_list(F.struct("sid", "at", "text"))).alias("t"))
    line = F.concat(F.lit("  • ["), F.get("t", F.lit(0))["at"], F.lit("]"), F.array_join(F.transform("t", lambda x: F.concat(F.lit("[sid="), x["sid"], F.lit("]"))), ""), F.lit(" "), F.array_join(F.transform("t", lambda x: x["text"]), " / "))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    return each.groupBy(query).agg(F.array_join(lines, "\n").alias("block"), F.count("*").alias("n"))
