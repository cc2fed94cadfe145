"""Queries that judge runs and diagnose failures, over labels, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import diagnosis as dx
from colloquy.operators import evaluation as ev
from colloquy.plans.catalogue import query
from colloquy.sources.tables import last_by_key, table

VERDICTS = "j as (select l.doc_id, d.source as category, case when l.doc_id % 11 = 0 then null else l.quality end as verdict, l.toxic from labels l join documents d using (doc_id))"


def _judged(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("category"))
    raw = F.when(F.col("doc_id") % 11 == 0, "0.5").otherwise(F.col("quality").cast("string"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "category", ev.as_binary(raw).alias("verdict"), "toxic")


@query(f"with {VERDICTS} select coalesce(category, 'ALL') as category, sum(verdict)::bigint as correct, count(*) as total, round(100.0 * sum(verdict) / count(*), 2) as accuracy from j where verdict is not null group by rollup (category)")
def verdict_accuracy_rollup(spark, sf_dir):
    return ev.accuracy_rollup(_judged(spark, sf_dir), "category", "verdict")


@query(f"with {VERDICTS}, m as (select category, avg(verdict) as mean from j group by category) select round(avg(mean), 6) as macro, count(*) as categories from m where category <> 'src5'")
def macro_average(spark, sf_dir):
    return ev.macro_average(_judged(spark, sf_dir), "category", "verdict", "src5")


VOTES = "votes as (select doc_id, run, case run when 1 then quality when 2 then 1 - toxic else (doc_id % 2)::int end as vote from labels, (select unnest([1, 2, 3, 4]) as run) where not (run = 4 and doc_id % 3 = 0))"


def _votes(spark, sf_dir):
    run = F.explode(F.array(*(F.lit(i) for i in (1, 2, 3, 4))))
    v = table(spark, sf_dir, "labels").withColumn("run", run).filter("not (run = 4 and doc_id % 3 = 0)")
    return v.select("doc_id", "run", F.when(F.col("run") == 1, F.col("quality")).when(F.col("run") == 2, 1 - F.col("toxic")).otherwise((F.col("doc_id") % 2).cast("int")).alias("vote"))


@query(f"with {VOTES} select doc_id, sum(vote)::bigint as yes, count(vote) as votes, case when arg_min(vote, run) = 1 or sum(vote) * 2 >= count(vote) then 1 else 0 end as final from votes group by doc_id")
def majority_vote_carry(spark, sf_dir):
    return ev.majority_with_carry(_votes(spark, sf_dir), "doc_id", "run", "vote")


@query(f"with {VOTES}, r as (select doc_id % 20 as grp, run, avg(vote) as acc from votes group by all) select grp, count(*) as runs, round(avg(acc), 6) as mean, round(stddev_pop(acc), 6) as std from r group by grp having count(*) >= 2")
def multi_run_mean_std(spark, sf_dir):
    r = _votes(spark, sf_dir).groupBy((F.col("doc_id") % 20).alias("grp"), "run").agg(F.avg("vote").alias("acc"))
    return ev.mean_std(r, "grp", "acc")


@query("""with a as (select doc_id, quality as v, doc_id % 5 as ctx, case when doc_id % 4 = 0 then null else 'k' end as kw from labels), b as (select doc_id, 1 - toxic as v, doc_id % 3 as ctx, case when doc_id % 8 = 0 then null else 'k' end as kw from labels)
select doc_id, a.v as before, b.v as after, a.ctx is distinct from b.ctx as ctx_changed, a.kw is distinct from b.kw as kw_changed from a join b using (doc_id) where a.v is distinct from b.v""")
def run_flips(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    a = lab.select("doc_id", F.col("quality").alias("v"), (F.col("doc_id") % 5).alias("ctx"), F.when(F.col("doc_id") % 4 != 0, "k").alias("kw"))
    b = lab.select("doc_id", (1 - F.col("toxic")).alias("v"), (F.col("doc_id") % 3).alias("ctx"), F.when(F.col("doc_id") % 8 != 0, "k").alias("kw"))
    return ev.flips(a, b, "doc_id", "v", ["ctx", "kw"])


@query("with a as (select doc_id, count(*) as a from labels where doc_id % 9 <> 0 group by doc_id), b as (select doc_id, count(*) as b from labels where doc_id % 10 <> 0 group by doc_id) select doc_id, coalesce(a, 0) as a, coalesce(b, 0) as b from a full join b using (doc_id) where coalesce(a, 0) <> 1 or coalesce(b, 0) <> 1")
def run_key_mismatch(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return ev.unmatched(lab.filter("doc_id % 9 <> 0"), lab.filter("doc_id % 10 <> 0"), "doc_id")


@query(f"with {VOTES} select doc_id, count(distinct vote) as verdicts, count(*) as runs, case when count(distinct vote) = 1 then 'unanimous' else 'disputed' end as status from votes group by doc_id")
def unanimous_vs_disputed(spark, sf_dir):
    return ev.disagreement(_votes(spark, sf_dir), "doc_id", "vote")


@query("""with gold as (select distinct o_custkey as q, l_suppkey as item from orders join lineitem on o_orderkey = l_orderkey where l_returnflag = 'R'), got as (select distinct o_custkey as q, l_suppkey as item from orders join lineitem on o_orderkey = l_orderkey where l_linenumber <= 2)
select q, count(*) as n_gold, count(got.item) as n_hit, count(*) = count(got.item) as all_hit from gold left join got using (q, item) group by q""")
def recall_all_gold_hit(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("q"), F.col("l_suppkey").alias("item"), "l_returnflag", "l_linenumber")
    return ev.recall(j.filter("l_returnflag = 'R'"), j.filter("l_linenumber <= 2"), "q", "item")


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, max(n) as n, min(value) as least, max(value) as most, max(case when i = least(n - 1, floor(0.25 * n)) then value end) as q25, max(case when i = least(n - 1, floor(0.5 * n)) then value end) as q50,
max(case when i = least(n - 1, floor(0.75 * n)) then value end) as q75, max(case when i = least(n - 1, floor(0.9 * n)) then value end) as q90 from r group by event_type""")
def score_quantiles_nearest(spark, sf_dir):
    return ev.nearest_quantiles(table(spark, sf_dir, "events"), "event_type", "value")


@query("select least(greatest(floor((value - 10.0) / 5.0), 0), 13)::int as bin, count(*) as n from events where value is not null group by 1")
def score_histogram(spark, sf_dir):
    return ev.histogram(table(spark, sf_dir, "events"), "value", 10.0, 80.0)


STAGES = "s as (select user_id, event_id, list_distinct([event_type, 'n' || (event_id % 3)]) as names from events)"


@query(f"with {STAGES}, p as (select *, coalesce(lag(names) over (partition by user_id order by event_id), []) as before from s) select user_id, event_id, array_to_string(list_sort(list_filter(names, lambda x: not list_contains(before, x))), ',') as added, array_to_string(list_sort(list_filter(before, lambda x: not list_contains(names, x))), ',') as removed from p")
def stage_drop_reasons(spark, sf_dir):
    s = table(spark, sf_dir, "events").select("user_id", "event_id", F.array("event_type", F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string"))).alias("names"))
    return dx.stage_diff(s, ["user_id"], "event_id", "names").select("user_id", "event_id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query("""select event_id, case when event_type = 'error' then 'exception' when event_id % 13 = 0 then 'empty_seed' when event_id % 17 = 0 then 'empty_evidence' when value < 20 then 'low_confidence' when not (user_id % 2 = 0) then 'off_topic' else 'judge_or_answer' end as failure,
case when event_id % 4 = 0 then 'not_applicable' when not (event_id % 3 = 0) then 'retrieval_failure' else 'answer_construction_failure' end as bridge from events""")
def failure_type_cascade(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", dx.failure_type(F.when(F.col("event_type") == "error", "e"), i % 13, i % 17, F.col("value"), F.col("user_id") % 2 == 0, 20).alias("failure"), dx.bridge(i % 4 == 0, i % 3 == 0).alias("bridge")
    )


@query("select event_id, array_to_string(list_filter([case when event_type = 'error' then 'error' end, case when value > 90 then 'high' end, case when event_id % 5 = 0 then 'fifth' end], lambda x: x is not null), ',') as flags from events")
def anomaly_flags(spark, sf_dir):
    flags = {"error": F.col("event_type") == "error", "high": F.col("value") > 90, "fifth": F.col("event_id") % 5 == 0}
    return table(spark, sf_dir, "events").select("event_id", F.array_join(dx.anomaly_flags(flags), ",").alias("flags"))


@query("""with o as (select *, first_value(event_type) over (partition by user_id order by event_id desc) as last_ from events), b as (select *, sum(case when event_type = last_ then 0 else 1 end) over (partition by user_id order by event_id desc rows unbounded preceding) as broken from o)
select user_id, count(*) as streak, any_value(last_) as value from b where broken = 0 group by user_id""")
def stuck_streak(spark, sf_dir):
    return ev.streak(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("select user_id, event_type, max(event_id) as event_id, arg_max(json_extract_string(props, '$.k')::int, event_id) as k from events group by user_id, event_type")
def event_last_by_type(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return last_by_key(e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "k")


@query("select event_id, json_extract_string(props, '$.k')::int as k, coalesce(json_extract_string(props, '$.missing'), 'none') as missing from events")
def json_prop_extract(spark, sf_dir):
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.coalesce(F.try_variant_get(v, "$.missing", "string"), F.lit("none")).alias("missing"))


@query("select user_id, time_bucket(interval 1 hour, ts)::varchar as hour, count(*) as n, round(sum(value), 4) as total from events group by all")
def tumbling_counts(spark, sf_dir):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    e = table(spark, sf_dir, "events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", "total")


@query("""with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as sid from o)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first, count(*) as n from s group by user_id, sid""")
def session_gap_windows(spark, sf_dir):
    s = F.session_window(F.col("ts").cast("timestamp"), "30 minutes")
    e = table(spark, sf_dir, "events").groupBy("user_id", s.alias("s")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("first"), "n")


@query("select user_id, event_type, event_id % 10 as slot, min(event_id) as event_id from events group by all")
def dedup_stream(spark, sf_dir):
    from colloquy.operators import provenance

    e = table(spark, sf_dir, "events").withColumn("slot", F.col("event_id") % 10)
    return provenance.latest(e, ["user_id", "event_type", "slot"], "event_id").select("user_id", "event_type", "slot", "event_id")


@query("""select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as link from pages""")
def regex_marker_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(tx.marker(F.col("html"), 'href="([^"]*)"')).alias("link"))


@query("select doc_id, substring(trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')), 1, 200) as answer from documents")
def norm_answer(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normal_answer(F.col("text")).alias("answer"))


@query("select doc_id, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') as name, case when length(text) > 100 then substring(text, 1, 100) || '…' else text end as short from documents")
def normalised_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normal_name(F.col("text")).alias("name"), tx.truncated(F.col("text"), 100).alias("short"))


@query("select user_id, case when count(*) filter (where event_type = 'view') = 0 then 'zero_entities' when count(*) filter (where event_type in ('purchase', 'signup')) = 0 then 'zero_delta' else 'ok' end as verdict from events group by user_id")
def ingest_delta_verdict(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == t).alias(t) for t in ("view", "purchase", "signup")))
    return e.select("user_id", dx.ingest_verdict(F.col("view"), F.col("purchase"), F.col("signup")).alias("verdict"))


@query("select event_type as stage, user_id % 5 as label, count(*) as calls, sum(event_id)::bigint as tokens from events group by rollup (event_type, user_id % 5)")
def token_usage_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), (F.col("user_id") % 5).alias("label"), "event_id")
    return e.rollup("stage", "label").agg(F.count("*").alias("calls"), F.sum("event_id").alias("tokens"))
