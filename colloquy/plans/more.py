"""Queries over lookups, parsers, predicates, resumption and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import parsing as ps
from colloquy.functions import text as tx
from colloquy.functions import vector as vec
from colloquy.operators import bm25, diagnosis, evidence, joins, provenance
from colloquy.operators import turns as turn_ops
from colloquy.plans.catalogue import query
from colloquy.plans.retrieval import BM25, _scored
from colloquy.sources import merge, sinks, store
from colloquy.sources.tables import last_by_key, table


@query(f"with {BM25}, b as (select *, max(score) over (partition by item_id) as best from scored) select item_id, doc_id, score from b where best > 0 and score >= round_even(best * 0.6, 1)")
def bm25_reference_cutoff(spark, sf_dir):
    return bm25.relative_cutoff(_scored(spark, sf_dir), "item_id").select("item_id", "doc_id", "score")


@query("select l.doc_id, case when length(text) > 200 then substring(text, 1, 200) || '…' else text end as text from labels l left join (select * from documents where doc_id % 3 <> 0 and trim(text) <> '') using (doc_id)")
def text_lookup_truncated(spark, sf_dir):
    return joins.lookup(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").filter("doc_id % 3 <> 0"), "doc_id", "text", 200)


@query("""with q as (select conv_id, turn, text from conversations where turn = 0), exact_ as (select c_name as k, c_custkey as v from customer where c_custkey % 2 = 0)
select o_orderkey, coalesce(a.v, b.v) as v, case when a.v is not null then 1 when b.v is not null then 2 end as step from orders left join (select c_custkey as k, c_custkey as v from customer where c_custkey % 2 = 0) a on o_custkey = a.k
left join (select c_nationkey as k, min(c_custkey) as v from customer group by 1) b on o_custkey % 20 = b.k""")
def prioritised_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("a"), (F.col("o_custkey") % 20).alias("b"))
    c = table(spark, sf_dir, "customer")
    one = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("a"), F.col("c_custkey").alias("v"))
    two = c.select(F.col("c_nationkey").cast("long").alias("b"), F.col("c_custkey").alias("v"))
    return joins.first_match(o, "o_orderkey", [(one, ["a"]), (two, ["b"])], "v")


@query("select c_custkey, coalesce(n_name, 'Unknown') as label from customer left join (select * from nation where n_nationkey % 4 <> 0) on c_nationkey = n_nationkey")
def category_join_back(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("label"))
    return joins.category_back(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), n, ["k"], "label").select("c_custkey", "label")


@query("with p as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as pos from conversations where role <> 'system') select conv_id, turn, pos // 2 as chunk from p where turn % 3 = 1")
def gold_chunk_mapping(spark, sf_dir):
    kept = turn_ops.positions(table(spark, sf_dir, "conversations").filter("role <> 'system'")).select("conv_id", "turn", "pos")
    gold = table(spark, sf_dir, "conversations").filter("turn % 3 = 1").select("conv_id", "turn")
    return joins.gold_chunks(gold, kept, ["conv_id", "turn"], 2).select("conv_id", "turn", "chunk")


@query("""with last_ as (select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1),
held as (select user_id, count(distinct s) as n from (select user_id, unnest([event_type, 'x' || (event_id % 4)]) as s from last_) where s in ('view', 'x1', 'x2') group by user_id)
select user_id, coalesce(n, 0) as n_gold from last_ left join held using (user_id)""")
def provenance_membership(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("prov", F.array("event_type", F.concat(F.lit("x"), (F.col("event_id") % 4).cast("string"))))
    gold = spark.createDataFrame([("view",), ("x1",), ("x2",)], "summary_id string")
    return diagnosis.latest_holding(e, gold, "user_id", "event_id", "prov")


@query("with w as (select distinct user_id from events where event_type = 'signup' and value > 50) select event_id, user_id from events where event_type = 'error' and user_id in (select user_id from w)")
def ingest_log_correlation(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("request_id"), F.col("event_type").alias("event"), "value")
    return diagnosis.failing_requests(log, "signup", ["error"], F.col("value") > 50).select("event_id", F.col("request_id").alias("user_id"))


@query("""with a as (select event_id // 3 as q, event_id % 3 as run, user_id % 2 as ans from events), g as (select q, ans, count(*) as support, min(run) as rep from a group by all)
select q, rep, support from (select *, row_number() over (partition by q order by support desc, rep) as n from g) where n = 1""")
def answer_cluster_majority(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("q"), (F.col("event_id") % 3).alias("run"), (F.col("user_id") % 2).alias("ans"))
    return joins.largest_cluster(a, "q", F.col("ans"), "run")


@query("""with a as (select event_id // 3 as q, event_id % 3 as run, (value > 60)::int as v, user_id % 5 as s from events)
select q, run, v, s from (select *, max(v) over (partition by q) as best, row_number() over (partition by q order by v desc, s desc, run) as b, row_number() over (partition by q order by run) as f from a) where case when best > 0 then b = 1 else f = 1 end""")
def verdict_pick(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("q"), (F.col("event_id") % 3).alias("run"), (F.col("value") > 60).cast("int").alias("v"), (F.col("user_id") % 5).alias("s"))
    return joins.verdict_pick(a, "q", "v", "s", "run")


@query("select c_custkey as id, 'missing' as side from customer where c_custkey not in (select o_custkey + 5 from orders) union all select distinct o_custkey + 5, 'extra' from orders where o_custkey + 5 not in (select c_custkey from customer)")
def expected_vs_actual_ids(spark, sf_dir):
    return joins.id_sets(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").select((F.col("o_custkey") + 5).alias("id")), "id")


@query("select doc_id, source as cleaned from documents")
def clean_fields(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    noisy = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('"'), "source", F.lit('"'))).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit('<|>junk##'))).otherwise(F.concat(F.lit(" "), "source", F.lit('");, ')))
    return d.select("doc_id", ps.clean_field(noisy).alias("cleaned"))


@query("""select event_id, case event_id % 6 when 0 then 1 when 1 then 0 when 2 then 1 when 3 then 0 when 4 then 0 end as verdict,
case event_id % 3 when 0 then 1 when 1 then 0 end as yes_no from events""")
def verdict_parsers(spark, sf_dir):
    i = F.col("event_id") % 6
    text = F.element_at(F.array(*map(F.lit, ['{"correct": true}', 'so {"correct": 0.5}', '{"label": "CORRECT"}', '{"label": "wrong"}', "It is incorrect.", "no idea"])), (i + 1).cast("int"))
    plain = F.element_at(F.array(*map(F.lit, ["Yes, it is", "**No**", "maybe"])), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", ps.parse_json_verdict(text).alias("verdict"), ps.parse_yes_no(plain).alias("yes_no"))


@query("select event_id, case when user_id % 7 < event_id % 5 then (user_id % 7) || ',' || (event_id % 5) when user_id % 7 = event_id % 5 then (user_id % 7)::varchar else (event_id % 5) || ',' || (user_id % 7) end as sessions from events")
def simplify_evidence(spark, sf_dir):
    text = F.concat(F.lit("D"), (F.col("event_id") % 5).cast("string"), F.lit(":4;D"), (F.col("user_id") % 7).cast("string"), F.lit(":3; D"), (F.col("event_id") % 5).cast("string"), F.lit(":9"))
    return table(spark, sf_dir, "events").select("event_id", ps.evidence_sessions(text).alias("sessions"))


@query("select o_orderkey, case o_orderkey % 4 when 3 then make_date(year(d), 1, 1) when 2 then date_trunc('month', d)::date else d end as first, case o_orderkey % 4 when 3 then make_date(year(d), 12, 31) when 2 then last_day(d) else d end as last from (select o_orderkey, o_orderdate::date as d from orders)")
def gold_date_ranges(spark, sf_dir):
    d, i = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(i == 0, F.date_format(d, "yyyy-MM-dd")).when(i == 1, F.concat(F.date_format(d, "d"), F.lit("th "), F.date_format(d, "MMMM, yyyy"))).when(i == 2, F.date_format(d, "MMMM yyyy")).otherwise(F.date_format(d, "yyyy"))
    a, b = ps.gold_range(F.col("t"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", a.alias("first"), b.alias("last"))


@query("select o_orderkey, d - (case when (isodow(d) - 1 - 3 + 7) % 7 = 0 then 7 else (isodow(d) - 1 - 3 + 7) % 7 end)::int as thursday_before from (select o_orderkey, o_orderdate::date as d from orders)")
def weekday_before(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", ps.weekday_before(F.col("o_orderdate").cast("date"), 3).alias("thursday_before"))


@query("""select conv_id, turn, regexp_matches(lower(text), 'when|date|day|week|month|year|time|before|after|since|ago|long|recent') as temporal, case when conv_id % 3 = 0 then true else false end as abstains, turn % 4 = 1 as overflow from conversations""")
def question_predicates(spark, sf_dir):
    gold = F.when(F.col("conv_id") % 3 == 0, "Not mentioned in the talk").otherwise("a fact")
    message = F.when(F.col("turn") % 4 == 1, "Error: maximum Context length exceeded").otherwise("timeout")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ps.asks_for_time(F.col("text")).alias("temporal"), ps.abstains(gold).alias("abstains"), ps.is_overflow(message).alias("overflow"))


@query("select p_partkey, case when p_partkey % 3 = 0 then p_type || ' ' || p_brand else p_name || ' [type=' || p_type || '] ' || p_brand end as entity, p_name || ' -> ' || p_brand || ' | ' || p_type || ' (keywords: ' || p_size || ')' as relation from part")
def representation_texts(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.entity_text(name, F.col("p_type"), F.col("p_brand")).alias("entity"), tx.relation_text(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")).alias("relation"))


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def resume_unprocessed(spark, sf_dir):
    done = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.unprocessed(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, "o_custkey").select("o_orderkey")


@query("with s as (select distinct n_nationkey as n from nation where n_nationkey > 0 and n_nationkey not in (9, 17)), g as (select n, n - row_number() over (order by n) as g from s) select max(case when g = 0 then n end)::int as highest, max((g > 0)::int) as after_gap from g")
def snapshot_prefix(spark, sf_dir):
    return sinks.latest_gapless(table(spark, sf_dir, "nation").filter("n_nationkey > 0 and n_nationkey not in (9, 17)").select(F.col("n_nationkey").alias("number")))


@query("with e as (select distinct user_id from events where event_type = 'view') select user_id, n, total from e left join (select user_id, count(*) as n, round(sum(value), 4) as total from events where event_type = 'error' group by 1) using (user_id)")
def samples_with_placeholders(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    got = e.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return joins.with_placeholders(e.filter("event_type = 'view'"), got, "user_id")


@query("select event_type, count(*) as n, round(100.0 * avg((event_id % 3 = 0)::int), 2) as fallback_pct, round(avg(user_id % 4), 4) as mean_kept, round(avg(event_id % 2), 4) as mean_added from events group by event_type")
def agent_statistics(spark, sf_dir):
    def ids(n):
        return F.array_repeat(F.lit("s"), n.cast("int"))

    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 3 == 0, "why").alias("f"), ids(F.col("user_id") % 4).alias("kept"), ids(F.col("event_id") % 2).alias("added"))
    return joins.agent_statistics(e, "event_type", "f", "kept", "added")


@query("""with e as (select n_regionkey as q, string_agg('- ' || n_name || ' (' || case when n_nationkey % 2 = 0 then 'Event' else 'Person' end || '): ' || 'd' || case when n_nationkey % 2 = 0 then ' [mentioned_at: 2024]' else '' end, chr(10) order by n_nationkey) as e from nation group by 1)
select q, '=== Entities ===' || chr(10) || e || chr(10) || '=== Relationships ===' || chr(10) || '- ' || r_name || ' -> x' as context from e join region on r_regionkey = q""")
def graph_context(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("q"), F.col("n_nationkey").alias("rank"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "Event").otherwise("Person").alias("type"), F.lit("d").alias("description"), F.lit("2024").alias("mentioned_at"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("q"), F.lit(1).alias("rank"), F.concat("r_name", F.lit(" -> x")).alias("label"))
    return evidence.render_graph(n, r, "q")


@query("select p_partkey, p_brand as source, p_type as target, p_name as description from part")
def relation_label_parse(spark, sf_dir):
    label = F.concat("p_brand", F.lit(" -> "), "p_type", F.lit(" | "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", evidence.relation_endpoints(label).alias("r")).select("p_partkey", "r.*")


@query("select user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, arg_max(event_type, event_id) as event_type from events group by all")
def source_map_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return last_by_key(e, ["user_id", "day"], "event_id").select("user_id", "day", "event_type")


@query("select id, name, pos from (select c_custkey % 30 as id, c_name as name, c_custkey as pos, row_number() over (partition by c_custkey % 30 order by c_custkey % 4 desc, c_custkey) as n from customer) where n = 1")
def vector_upsert_richest(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 30).alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("pos"), F.array_repeat(F.lit("e"), (F.col("c_custkey") % 4).cast("int")).alias("prov"))
    return provenance.richest(c, "id", "prov", "pos").select("id", "name", "pos")


@query("select event_id, least(1.0, value / 100 + 0.5 * (value / 200)) as activation, case when (value / 100 - 0.4) / 0.6 > 0 then round((value / 100 - 0.4) / 0.6, 9) end as weight from events")
def activation_math(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", vec.saturating_add(v / 100, F.lit(0.5) * (v / 200)).alias("activation"), F.round(vec.rescaled(v / 100, 0.4), 9).alias("weight"))


@query()
def sentence_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(ps.chunked("text", F.lit(600))).alias("n", "chunk"))


@query("select event_id, trim(event_type) as scrubbed from events")
def scrub_tags(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.scrub(F.concat(F.lit("<|start|><think>so\nlong</think>"), "event_type", F.lit("</s><|im_end|> "))).alias("scrubbed"))


_PROGRESS = "user_id long, status string, n long, note string, history string"


@query("""with u as (select user_id, event_type, count(*) as n, max(event_id) as last from events group by all),
r as (select *, case event_type when 'view' then 1 when 'click' then 2 when 'error' then 3 end as round from u where event_type in ('view', 'click', 'error'))
select s.user_id, arg_max(r.event_type, r.round) as status, arg_max(r.n, r.round) as n, 'signed up' as note, string_agg(r.event_type || ' ' || r.n, '; ' order by r.round) as history
from (select user_id from u where event_type = 'signup') s left join r using (user_id) group by s.user_id
union all select user_id, 'error', n, null, 'error ' || n from r where round = 3 and user_id not in (select user_id from u where event_type = 'signup')""")
def progress_history(spark, sf_dir):
    """A table of progress: rows for all that signed up, two rounds of changes to these alone, and a third that also brings new ones; the last round comes in twice."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    path, none = store.shared_dir(spark, "progress"), F.lit(None).cast("string")
    first = counts.filter("event_type = 'signup'").select("user_id", none.alias("status"), F.lit(None).cast("long").alias("n"), F.lit("signed up").alias("note"), none.alias("history"))
    merge.create(first, path, ["user_id"])
    for kind in ("view", "click", "error", "error"):
        told = counts.filter(F.col("event_type") == kind).select("user_id", F.col("event_type").alias("status"), "n", F.concat_ws(" ", "event_type", F.col("n").cast("string")).alias("history"))
        merge.merge(told, path, _PROGRESS, ["user_id"], history=["history"], insert=kind == "error")
    return merge.read(spark, path, _PROGRESS)
