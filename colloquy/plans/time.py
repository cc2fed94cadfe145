"""Queries over dates: formats, relative expressions, ranges and containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import temporal as t
from colloquy.operators import phrases, ranking
from colloquy.operators.bm25 import spread
from colloquy.plans.catalogue import query
from colloquy.sources.tables import table


def _days(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")


@query("""select event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') as parsed, event_id % 3 = 2 as missing from events where event_id % 3 <> 2
union all select event_id, null, true from events where event_id % 3 = 2""")
def timestamp_multi_format(spark, sf_dir):
    ts = F.col("ts")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy/MM/dd (EEE) HH:mm")).when(F.col("event_id") % 3 == 1, F.concat(F.lower(F.date_format(ts, "h:mm a")), F.lit(" on "), F.date_format(ts, "d MMMM, yyyy"))).otherwise("soon")
    p = t.parse_time(text)
    return table(spark, sf_dir, "events").select("event_id", F.date_format(p, "yyyy-MM-dd HH:mm:ss").alias("parsed"), p.isNull().alias("missing"))


@query("""select o_orderkey, d - (case when (isodow(d) - 1 - 1) % 7 = 0 then 7 else (isodow(d) + 5) % 7 end)::int as last_tuesday,
  date_trunc('week', d)::date + 4 as this_friday, d + (case when (7 - isodow(d)) = 0 then 7 else 7 - isodow(d) end)::int as next_sunday
from (select o_orderkey, o_orderdate::date as d from orders)""")
def relative_weekday_dates(spark, sf_dir):
    d = F.col("day")
    return _days(spark, sf_dir).select("o_orderkey", t.weekday_target(d, 1, "last").alias("last_tuesday"), t.weekday_target(d, 4, "this").alias("this_friday"), t.weekday_target(d, 6, "next").alias("next_sunday"))


@query("""select o_orderkey, w - 7 as last_week, w - 1 as last_week_end, w + 7 as next_week, w - 2 as last_weekend, w + 5 as this_weekend, w + 13 as next_weekend_end
from (select o_orderkey, date_trunc('week', o_orderdate)::date as w from orders)""")
def week_weekend_ranges(spark, sf_dir):
    d = F.col("day")
    return _days(spark, sf_dir).select(
        "o_orderkey", t.week_range(d, "last")[0].alias("last_week"), t.week_range(d, "last")[1].alias("last_week_end"), t.week_range(d, "next")[0].alias("next_week"),
        t.weekend_range(d, "last")[0].alias("last_weekend"), t.weekend_range(d, "this")[0].alias("this_weekend"), t.weekend_range(d, "next")[1].alias("next_weekend_end"),
    )


@query("""select o_orderkey, (date_trunc('month', d) - interval 1 month)::date as last_month, (date_trunc('month', d) - interval 1 day)::date as last_month_end, make_date(year(d) + 1, 12, 31) as next_year_end,
  make_date(year(d), 6, 1) as summer, make_date(year(d), 8, 31) as summer_end, make_date(year(d), 12, 1) as winter, (make_date(year(d) + 1, 3, 1) - interval 1 day)::date as winter_end from (select o_orderkey, o_orderdate::date as d from orders)""")
def month_season_year_ranges(spark, sf_dir):
    d = F.col("day")
    y = F.year(d)
    return _days(spark, sf_dir).select(
        "o_orderkey", t.month_range(d, -1)[0].alias("last_month"), t.month_range(d, -1)[1].alias("last_month_end"), t.year_range(d, 1)[1].alias("next_year_end"),
        t.season_range(y, "summer")[0].alias("summer"), t.season_range(y, "summer")[1].alias("summer_end"), t.season_range(y, "winter")[0].alias("winter"), t.season_range(y, "winter")[1].alias("winter_end"),
    )


_G = "case o_orderkey % 7 when 0 then 'day' when 1 then 'week' when 2 then 'month' when 3 then 'year' when 4 then 'season' when 5 then 'range' else 'weekend' end"
_INSIDE = f"""inside as (select o_orderkey, o_custkey, g, case g when 'day' then d = s when 'week' then abs(date_diff('day', s, d)) <= 7 when 'month' then year(d) = year(s) and month(d) = month(s)
  when 'year' then year(d) = year(s) when 'weekend' then false else d between s and s + 20 end as contained
  from (select o_orderkey, o_custkey, {_G} as g, o_orderdate::date as d, o_orderdate::date - (o_orderkey % 15)::int as s from orders))"""


def _inside(spark, sf_dir):
    g = F.element_at(F.array(*(F.lit(x) for x in ("day", "week", "month", "year", "season", "range", "weekend"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", g.alias("g"), F.col("o_orderdate").cast("date").alias("d")).withColumn("s", F.date_sub("d", (F.col("o_orderkey") % 15).cast("int")))
    return d.select("o_orderkey", "o_custkey", "g", t.contained(F.col("d"), F.col("s"), F.date_add("s", 20), F.col("g")).alias("contained"))


@query(f"with {_INSIDE} select o_orderkey, g, contained from inside")
def date_containment(spark, sf_dir):
    return _inside(spark, sf_dir).select("o_orderkey", "g", "contained")


@query(f"with {_INSIDE} select o_custkey, o_orderkey, contained, row_number() over (partition by o_custkey order by case when contained then 0 else 1 end, o_orderkey) as boosted_rank from inside")
def containment_boost_sort(spark, sf_dir):
    return ranking.containment_boost(_inside(spark, sf_dir), "o_custkey", "contained", "o_orderkey").select("o_custkey", "o_orderkey", "contained", "boosted_rank")


@query("""with b as (select event_id, ts, case event_id % 3 when 0 then 'before' when 1 then 'after' else 'since' end as op from events),
r as (select *, case op when 'after' then timestamp '2024-06-30 23:59:59.999999' + interval 1 microsecond when 'since' then timestamp '2024-06-01' end as lo, case op when 'before' then timestamp '2024-06-01' - interval 1 microsecond end as hi from b)
select event_id, op, (lo is null or ts >= lo) and (hi is null or ts <= hi) as inside from r""")
def temporal_boundary_filter(spark, sf_dir):
    op = F.element_at(F.array(F.lit("before"), F.lit("after"), F.lit("since")), (F.col("event_id") % 3 + 1).cast("int"))
    lo, hi = t.boundary(F.col("op"), F.lit("2024-06-01").cast("timestamp_ntz"), F.lit("2024-06-30 23:59:59.999999").cast("timestamp_ntz"))
    e = table(spark, sf_dir, "events").select("event_id", "ts", op.alias("op")).withColumn("lo", lo).withColumn("hi", hi)
    return e.select("event_id", "op", ((F.col("lo").isNull() | (F.col("ts") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("ts") <= F.col("hi")))).alias("inside"))


_SAID = """x as (select event_id, ts, event_id % 9 + 1 as n, dayname(ts + interval (event_id % 7) day) as w, (isodow(ts + interval (event_id % 7) day)) as wd from events),
d as (select *, 'last ' || w as p1, n || ' weeks ago' as p2, strftime(ts, '%B %Y') as p3, 'the week after ' || strftime(ts, '%Y-%m-%d') as p4, ts::date - (((isodow(ts) - wd + 6) % 7) + 1)::int as d1, ts::date - (7 * n)::int as d2, date_trunc('month', ts)::date as d3, date_trunc('week', ts)::date + 7 as d4 from x),
s as (select *, 'met ' || p1 || ', ' || p2 || ' or in ' || p3 || '; until ' || p4 as text from d)"""


def _said(spark, sf_dir):
    """Texts that name a weekday, a number of weeks, a month and a day of each event."""
    e = spread(table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ref")))
    day = F.date_format(F.date_add(F.col("ref").cast("date"), (F.col("event_id") % 7).cast("int")), "EEEE")
    text = F.concat(F.lit("met last "), day, F.lit(", "), (F.col("event_id") % 9 + 1).cast("string"), F.lit(" weeks ago or in "), F.date_format("ref", "MMMM yyyy"), F.lit("; until the week after "), F.date_format("ref", "yyyy-MM-dd"))
    return e.withColumn("text", text)


@query(f"""with {_SAID}, r as (select event_id, p1 as phrase, strpos(text, p1) - 1 as start, 'relative_weekday' as category, 'day' as granularity, d1 as a, d1 as b, d1::text as display from s union all select event_id, p2, strpos(text, p2) - 1, 'relative_window', 'day', d2, d2, d2::text from s
union all select event_id, p3, strpos(text, p3) - 1, 'month_point', 'month', d3, last_day(d3), strftime(d3, '%Y-%m') from s union all select event_id, p4, strpos(text, p4) - 1, 'week_point', 'week', d4, d4 + 6, 'week of ' || d4 from s)
select event_id, phrase, start, category, granularity, 'resolved' as status, a::text || ' 00:00:00' as since, b::text || ' 23:59:59' as until, display from r""")
def temporal_spans_extract(spark, sf_dir):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    found = phrases.spans(_said(spark, sf_dir), "event_id", "text", "ref")
    return found.select("event_id", F.col("text").alias("phrase"), F.col("start").cast("long").alias("start"), "category", "granularity", "status", at("since").alias("since"), at("until").alias("until"), "display")


@query(f"""with {_SAID} select event_id, 'met on ' || d1 || ', on ' || d2 || ' or in ' || strftime(d3, '%Y-%m') || '; until week of ' || d4 as question,
'met ' || p1 || ' [DATE: ' || d1 || '], ' || p2 || ' [DATE: ' || d2 || '] or in ' || p3 || ' [TIMESPAN: ' || strftime(d3, '%Y-%m') || ']; until ' || p4 || ' [TIMESPAN: week of ' || d4 || ']' as augmented from s""")
def temporal_rewrite(spark, sf_dir):
    said = _said(spark, sf_dir)
    return phrases.augmented(phrases.rewritten(said, "event_id", "text", "ref"), "event_id", "text", "ref").select("event_id", "question", "augmented")


@query(f"""with {_SAID} select event_id, lower(p1) as phrase, d1::text as display from s union all select event_id, p2, d2::text from s union all select event_id, lower(p3), strftime(d3, '%Y-%m') from s union all select event_id, p4, 'week of ' || d4 from s""")
def temporal_hints(spark, sf_dir):
    return phrases.hints(_said(spark, sf_dir), "event_id", "text", "ref")


@query(f"""with {_SAID} select event_id, true as has_time, 4 as n, p1 as phrase, d4::text || ' ' || (d4 + 6)::text as last from s""")
def temporal_detect(spark, sf_dir):
    e = F.col("expressions")
    return phrases.detected(_said(spark, sf_dir), "event_id", "text", "ref").select("event_id", "has_time", F.size(e).alias("n"), e[0]["text"].alias("phrase"), F.concat_ws(" ", F.element_at(e, -1)["start"], F.element_at(e, -1)["end"]).alias("last"))
