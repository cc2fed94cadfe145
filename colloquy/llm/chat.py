"""Dialogues from every participant's side.

For each participant a dialogue is rendered with that speaker as the assistant and all others
as named users; the spans that the assistant said are what a model is trained on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turn numbers in one row of output; longer dialogues take several parts.
PART = 128


def rotate(turns: DataFrame, speaker: str = "role", part_turns: int | None = PART) -> DataFrame:
    """Render turns (conv_id, turn, speaker, text) once for each participant of the conversation.

    Returns conv_id, part, perspective, n_turns, n_own, rendered, spans: one row per conversation,
    participant and part of part_turns turn numbers, so a row is bounded however long a dialogue is;
    parts in order give the whole. part_turns=None renders every dialogue whole, in part 0. Participants are all speakers but "system", lower-cased and trimmed.
    spans: "first-after" character places in rendered that the perspective said with the end mark,
    comma-separated; the mask of all else is 0.

    Turns are ordered by number, null numbers last (in a part of their own, with number -1), ties by
    speaker and text; equal rows are one turn. A null or blank speaker is "unknown", a null text empty.
    "<|" in texts and names becomes "< |", so no text can end a turn. A conversation of system turns
    alone, and rows with a null conv_id, give no row; neither does an empty table. Other columns are not read.
    """
    clean = F.lower(F.trim(F.coalesce(F.col(speaker), F.lit(""))))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.replace(F.when(clean == "", "unknown").otherwise(clean), F.lit("<|"), F.lit("< |")).alias("who"),
        F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("said"),
    ).distinct()
    sides = rows.filter("who <> 'system'").select("conv_id", F.col("who").alias("perspective")).distinct()
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long") if part_turns else F.lit(0).cast("long")
    parts = rows.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct(F.col("turn").isNull().alias("late"), "turn", "who", "said"))).alias("turns"))
    both = parts.join(sides, "conv_id")

    def render(t):
        head = F.when(t["who"] == F.col("perspective"), F.lit("<|im_start|>assistant\n")).when(t["who"] == "system", F.lit("<|im_start|>system\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), t["who"], F.lit("\n")))
        return F.struct(head.alias("head"), F.concat(t["said"], F.lit("<|im_end|>")).alias("body"), (t["who"] == F.col("perspective")).alias("own"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def walk(acc, s):
        first = acc["at"] + F.length(s["head"])
        after = first + F.length(s["body"])
        return F.struct((after + 1).alias("at"), F.when(s["own"], F.array_append(acc["spans"], F.concat_ws("-", first, after))).otherwise(acc["spans"]).alias("spans"))

    shaped = both.withColumn("segments", F.transform("turns", render))
    return shaped.select(
        "conv_id",
        "part",
        "perspective",
        F.size("segments").cast("long").alias("n_turns"),
        F.size(F.filter("segments", lambda s: s["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "").alias("rendered"),
        F.array_join(F.aggregate("segments", start, walk)["spans"], ",").alias("spans"),
    )


SQL = """
with rows_ as (
  select distinct conv_id, turn, replace(case when lower(trim(coalesce(role, ''))) = '' then 'unknown' else lower(trim(role)) end, '<|', '< |') as who,
         replace(coalesce(text, ''), '<|', '< |') as said
  from conversations where conv_id is not null),
sides as (select distinct conv_id, who as perspective from rows_ where who <> 'system'),
segments as (
  select r.conv_id, coalesce(floor(turn / 128), -1)::bigint as part, perspective, turn, who, said, who = perspective as own,
         case when who = perspective then '<|im_start|>assistant' || chr(10) when who = 'system' then '<|im_start|>system' || chr(10)
              else '<|im_start|>user name=' || who || chr(10) end as head,
         said || '<|im_end|>' as body
  from rows_ r join sides s on r.conv_id = s.conv_id),
placed as (
  select *, sum(length(head) + length(body) + 1) over (partition by conv_id, part, perspective order by turn, who, said) - length(body) - 1 as first_
  from segments)
select conv_id, part, perspective, count(*) as n_turns, count(*) filter (where own) as n_own,
       string_agg(head || body || chr(10), '' order by turn, who, said) as rendered,
       coalesce(string_agg(first_::bigint || '-' || (first_ + length(body))::bigint, ',' order by turn, who, said) filter (where own), '') as spans
from placed group by conv_id, part, perspective
"""
