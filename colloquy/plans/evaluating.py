"""Queries over runs: reachability, flips, merged files, replays, diagnosis bundles, selection and completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import settings
from colloquy.functions import models
from colloquy.functions import parsing as ps
from colloquy.operators import diagnosis as dx
from colloquy.operators import evaluation as ev
from colloquy.operators import evidence, ranking
from colloquy.operators import ingest as ing
from colloquy.operators import joins
from colloquy.operators import turns as turn_ops
from colloquy.plans.catalogue import query
from colloquy.plans.dialogue import PAIRS
from colloquy.sources import store
from colloquy.sources.tables import table


@query("""with q as (select user_id % 6 as category, value > 20 as seen, value > 60 and event_type <> 'error' as kept from events)
select coalesce(category::varchar, 'TOTAL') as category, count(*) as n, sum(seen::int)::bigint as seen, sum(kept::int)::bigint as kept, round(sum(seen::int) / count(*), 6) as seen_share, round(sum(kept::int) / count(*), 6) as kept_share
from q group by rollup (category)""")
def reachability_rollup(spark, sf_dir):
    q = table(spark, sf_dir, "events").select((F.col("user_id") % 6).cast("string").alias("category"), F.coalesce(F.col("value") > 20, F.lit(False)).alias("seen"), F.coalesce((F.col("value") > 60) & (F.col("event_type") != "error"), F.lit(False)).alias("kept"))
    return ev.reachability(q, "category", ["seen", "kept"])


@query("select user_id, event_type, count(*) as n, min(event_id) as first, max(event_id) as last from events group by all")
def trace_groups(spark, sf_dir):
    return ev.event_groups(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("select doc_id, (doc_id % 4 = 0)::int as late, row_number() over (partition by doc_id % 4 = 0 order by doc_id) as place from labels where quality = 0 and toxic = 0")
def judge_flips_within(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("second", 1 - F.col("toxic"))
    return ev.flips_within(rows, "doc_id", "quality", "second", 0, 1, F.col("doc_id") % 4 == 0).select("doc_id", "late", "place")


@query("""with m as (select doc_id, quality as v, 'merged' as sample from labels where doc_id % 3 = 0), p as (select doc_id, toxic as v, 's' || (doc_id % 5) as sample from labels)
select * from m union all select * from p where doc_id not in (select doc_id from m)""")
def merged_judged(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    merged = lab.filter("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("v"), F.lit("merged").alias("sample"))
    return ev.merged_runs(lab.select("doc_id", F.col("toxic").alias("v"), F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string")).alias("sample")), merged, ["doc_id"])


@query("select user_id, arg_min(event_type, event_id) as event_type, arg_max(round(value, 4), event_id) as last_value from (select * from events where value is not null) group by user_id")
def replay_first_last(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value is not null").withColumn("last_value", F.round("value", 4))
    return ev.first_and_last(e, "user_id", "event_id", ["event_type"], ["last_value"])


@query("""with e as (select *, case when event_id % 7 = 0 then null else (event_id % 3 = 0)::int end as verdict from events)
select event_id, verdict, array_to_string(list_filter([case when event_type = 'error' then 'error' end, case when value > 90 then 'high' end], lambda x: x is not null), ',') as flags,
case when verdict = 0 then case when event_type = 'error' then 'exception' when value < 20 then 'low_confidence' else 'judge_or_answer' end end as cause from e""")
def diagnosis_bundle(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    judged = e.filter("event_id % 7 <> 0").select("event_id", (F.col("event_id") % 3 == 0).cast("int").alias("verdict"))
    flags = F.array_join(dx.anomaly_flags({"error": F.col("event_type") == "error", "high": F.col("value") > 90}), ",")
    cause = dx.failure_type(F.when(F.col("event_type") == "error", "e"), F.lit(1), F.lit(1), F.coalesce("value", F.lit(100.0)), F.lit(True), 20)
    return ev.diagnosis_bundle(e, judged, "event_id", "verdict", flags, cause)


@query("""with r as (select l_orderkey as q, l_linenumber as o, l_partkey as k from lineitem)
select 'name' as variant, q, string_agg(p_name, chr(10) order by o, p_name) as context from r join part on p_partkey = k group by q
union all select 'type', q, string_agg(p_type, chr(10) order by o, p_type) from r join part on p_partkey = k where p_partkey % 2 = 0 group by q""")
def replay_text_variants(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("o"), F.col("l_partkey").alias("k"))
    p = table(spark, sf_dir, "part")
    texts = {"name": p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("text")), "type": p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("text"))}
    return ev.text_variants(r, texts, "q", "k", "o")


@query("""select event_id, case event_id % 4 when 0 then 'raw' when 1 then event_type when 2 then 'u' || user_id else 'summary' end as text from events""")
def raw_text_chain(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id") % 4
    found = F.when(i == 2, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return e.select("event_id", ev.raw_text(F.when(i == 0, "raw").otherwise("  "), F.when(i == 1, F.col("event_type")), found, F.lit("summary")).alias("text"))


@query("""with e as (select *, 'f' || (user_id % 60) || case when user_id % 5 = 0 then '_abs' else '' end as file from events), f as (select *, row_number() over (partition by file order by event_id) as n from e),
v as (select file, case when ends_with(file, '_abs') then event_id % 2 when event_id % 3 < 2 then event_id % 3 end::int as verdict, case when event_id % 4 = 0 then 'second' else 'a' || event_id end as answer from f where n = 1)
select * from v where verdict is not null""")
def scored_items(spark, sf_dir):
    i = F.col("event_id")
    file = F.concat(F.lit("f"), (F.col("user_id") % 60).cast("string"), F.when(F.col("user_id") % 5 == 0, "_abs").otherwise(""))
    rows = table(spark, sf_dir, "events").select(
        file.alias("file"), "event_id", F.when(i % 3 == 2, "0.5").otherwise((i % 3).cast("string")).alias("usual"), (i % 2).cast("string").alias("abstention"), F.when(i % 4 == 0, " ").otherwise(F.concat(F.lit("a"), i.cast("string"))).alias("one"), F.lit("second").alias("two")
    )
    return ev.scored_items(rows, "file", "event_id", "usual", "abstention", ["one", "two"])


@query("""select event_id, case when event_id % 3 = 0 then event_type when event_id % 3 = 1 then 'u' || user_id else '' end as gold, event_type like '%ur%' or event_type like '%gn%' as asked, event_type in ('view', 'error') as layered from events""")
def question_selection(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id") % 3
    gold = ev.gold_answer(F.when(i == 0, F.col("event_type")).otherwise(" "), F.when(i == 1, F.concat(F.lit("u"), F.col("user_id").cast("string"))))
    kinds = settings.Agent(categories=("view", "error")).categories
    return e.select("event_id", gold.alias("gold"), ev.contains_any(F.col("event_type"), ["UR", "gn"]).alias("asked"), F.col("event_type").isin(*kinds).alias("layered"))


@query("select n_regionkey::bigint as region, count(*) as total, count(*) filter (where n_nationkey in (select c_nationkey from customer where c_acctbal > 9000)) as done from nation group by 1")
def completion_counts(spark, sf_dir):
    planned = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("region"), F.col("n_nationkey").alias("k"))
    return ev.completion(planned, table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), "region", "k")


@query("select o_orderkey from orders where (o_orderstatus = 'F' or trim(coalesce(case when o_orderkey % 9 = 0 then ' ' else o_orderpriority end, '')) = '') and o_custkey in (select c_custkey from customer where c_acctbal > 2000)")
def rerun_selection(spark, sf_dir):
    """Questions that failed or have a blank context, whose artifacts exist."""
    o = table(spark, sf_dir, "orders").withColumn("context", F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise(F.col("o_orderpriority")))
    artifacts = table(spark, sf_dir, "customer").filter("c_acctbal > 2000").select(F.col("c_custkey").alias("o_custkey"))
    return joins.needs_rerun(o, F.col("o_orderstatus") == "F", "context").join(artifacts, "o_custkey", "left_semi").select("o_orderkey")


@query("""with v as (select 'narrow' as variant, 5 as k, 0.3 as least union all select 'usual', 20, 0.2 union all select 'loose', 20, 0.0), r as (select *, row_number() over (partition by user_id order by value desc, event_id) as n from events where value is not null)
select variant, count(*) as kept, count(distinct user_id) as users from v join r on n <= k and value / 100 >= least group by variant""")
def parameter_sweep(spark, sf_dir):
    """One plan for each variant of the settings, under its name."""
    e = table(spark, sf_dir, "events").filter("value is not null")
    every = None
    for name, s in settings.sweep(settings.Search(), {"narrow": {"entity_topk": 5, "entity_threshold": 0.3}, "usual": {}, "loose": {"entity_threshold": 0.0}}).items():
        best = ranking.top_of(e, "user_id", "event_id", "value", s.entity_topk).filter(F.col("value") / 100 >= s.entity_threshold)
        one = best.agg(F.count("*").alias("kept"), F.count_distinct("user_id").alias("users")).select(F.lit(name).alias("variant"), "kept", "users")
        every = one if every is None else every.union(one)
    return every


@query("""select conv_id, string_agg(role || ': ' || case when turn % 2 = 0 then 'it was [2024-01-0' || (turn % 9 + 1) || '] then' else text end, chr(10) order by turn) as body from conversations group by conv_id""")
def session_raw_text(spark, sf_dir):
    """Lines by speaker, each turn with its own text of time."""
    t = table(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("it was [2024-01-0"), (F.col("turn") % 9 + 1).cast("string"), F.lit("] then"))).otherwise(F.col("text"))
    return turn_ops.session_concat(t.withColumn("text", said)).select("conv_id", F.col("content").alias("body"))


@query("""select event_id, case event_id % 3 when 0 then event_type || ' | u' || user_id when 1 then 'whole ' || event_type else 'only' end as facts, case event_id % 3 when 0 then 2 when 1 then 0 else 1 end::bigint as n from events""")
def fact_fanout(spark, sf_dir):
    i = F.col("event_id") % 3
    answer = F.when(i == 0, F.concat(F.lit('["'), "event_type", F.lit('", "u'), F.col("user_id").cast("string"), F.lit('"]'))).when(i == 1, "no list").otherwise('[" ", "only"]')
    return ps.facts(table(spark, sf_dir, "events").select("event_id", answer.alias("a"), F.concat(F.lit("whole "), "event_type").alias("raw")), "event_id", "a", "raw")


@query(f"""with {PAIRS} select conv_id, count(*) as n, string_agg(regexp_replace(assistant_text, '^[^:]{{1,20}}:\\s*', ''), ' ' order by message_id) as body from pairs group by conv_id""")
def session_ingest_map(spark, sf_dir):
    p = turn_ops.turn_pairs(table(spark, sf_dir, "conversations")).withColumn("line", ing.without_speaker(F.col("assistant_text")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("message_id", "line"))), lambda x: x["line"]), " ")
    return p.groupBy("conv_id").agg(F.count("*").alias("n"), body.alias("body"))


@query("""select user_id, arg_min(event_type, event_id) as question, coalesce(arg_min(case when event_id % 3 = 0 then 'a' || event_id end, event_id), arg_min(case when event_id % 2 = 0 then 'b' || event_id end, event_id), 'none') as asked_on from events group by user_id""")
def question_date_first(spark, sf_dir):
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("question"), F.when(i % 3 == 0, F.concat(F.lit("a"), i.cast("string"))).alias("d1"), F.when(i % 2 == 0, F.concat(F.lit("b"), i.cast("string"))).alias("d2"))
    return joins.first_question(e, "user_id", "event_id", "question", ["d1", "d2"], "none").withColumnRenamed("date", "asked_on")


@query("select event_id, user_id::varchar as request_id, round(value, 4) as score from events where user_id in (1, 7, 12) and value is not null")
def rerank_scores_by_request(spark, sf_dir):
    """Scores are appended to a log in two batches and read back for the asked requests, whose ids are compared as trimmed text."""
    path = store.shared_dir(spark, "scores")
    e = table(spark, sf_dir, "events").filter("value is not null").select("event_id", F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")).alias("request_id"), F.round("value", 4).alias("score"))
    for part in (0, 1):
        evidence.append_scores(e.filter(F.col("event_id") % 2 == part), path)
    return evidence.scores_of(spark, path, e.schema, [" 1", "7 ", "12"])


@query("""select r_name as child, string_agg(n_name, ',' order by n_nationkey) as datasets from nation join region on n_regionkey = r_regionkey where n_nationkey % 25 in (1, 2, 3, 5, 8, 13, 21) and r_name <> 'ASIA' group by r_name""")
def dataset_plan(spark, sf_dir):
    """Datasets by their places, without an excluded type, grouped by the child that runs them."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joins.planned(n, "n_nationkey", "n_name", "r_name", [1, 2, 3, 5, 8, 13, 21], ["ASIA"]).withColumnRenamed("r_name", "child")


@query("""select c_custkey, case when c_custkey % 3 = 0 then c_mktsegment when c_custkey % 3 = 1 then 'kept' else '' end as answer, c_custkey % 3 = 0 as fresh from customer""")
def resampled_answers(spark, sf_dir):
    """Stored contexts are answered again from a table of recorded answers; questions without one keep their answer."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("prompt"), F.when(F.col("c_custkey") % 3 == 1, "kept").otherwise("").alias("old"))
    recorded = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.sha2("c_name", 256).alias("key"), F.col("c_mktsegment").alias("answer"))
    got = models.replayed(c, recorded, "prompt")
    return got.select("c_custkey", F.coalesce("answer", "old").alias("answer"), F.col("answer").isNotNull().alias("fresh"))
