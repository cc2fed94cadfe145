"""Queries over streams: ordered ingestion, and logs joined in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.plans.catalogue import query
from colloquy.sources import store
from colloquy.sources.tables import table
from colloquy.streaming import logs, ordered

_NAMES = "list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}'))"


@query(f"""with m as (select conv_id, turn, unnest({_NAMES}) as name from conversations where role <> 'system'),
w as (select *, row_number() over v as mentions, min(turn) over v as first_turn, lag(turn) over v as previous_turn from m window v as (partition by conv_id, name order by turn))
select conv_id, turn, name, case when mentions = 1 then 'ADD' else 'UPDATE' end as action, mentions, first_turn, previous_turn from w""")
def ordered_ingestion(spark, sf_dir):
    """The table is read as a stream; the turns of a conversation carry their number as time, after the time that watermarks start at."""
    schema = table(spark, sf_dir, "conversations").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parque[t]")  # as a pattern, a table of one file is a source as well
    names = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0)))
    turns = stream.select("conv_id", "turn", F.timestamp_seconds(F.col("turn") + 86_400).alias("ts"), F.when(F.col("role") != "system", names).otherwise(F.array().cast("array<string>")).alias("names"))
    return ordered.taken_in(turns, store.shared_dir(spark, "ingested"), late="1 day")


@query("""with r as (select event_id as request, user_id::varchar as user_id, ts from events where event_type = 'view'), a as (select event_id as answer, user_id::varchar as user_id, ts, value from events where event_type = 'purchase')
select r.user_id, request, answer, round(value, 4) as value from r left join a on r.user_id = a.user_id and a.ts between r.ts and r.ts + interval 12 hour""")
def log_partners(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("user_id", F.col("user_id").cast("string"))
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("request"))
    bought = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    met = logs.partnered(views, bought, "user_id", within="12 hours")
    return met.select("user_id", "request", F.col("answer_event_id").alias("answer"), F.round("answer_value", 4).alias("value"))
