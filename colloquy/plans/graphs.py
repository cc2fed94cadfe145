"""Queries over the foreign-key graph, event provenance and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import graph as g
from colloquy.operators import knn
from colloquy.operators import provenance as prov
from colloquy.plans.catalogue import query
from colloquy.plans.retrieval import COSINE
from colloquy.sources.tables import table

V = """v as (select 'c' || c_custkey as id, c_name as name from customer where c_custkey % 7 <> 0 union all select 'n' || n_nationkey, n_name from nation union all select 'r' || r_regionkey, r_name from region)"""
E = """e as (select 'c' || c_custkey as src, 'cn' || c_custkey as rel, 'n' || c_nationkey as dst from customer union all select 'n' || n_nationkey, 'nr' || n_nationkey, 'r' || n_regionkey from nation)"""


def _id(p, c):
    return F.concat(F.lit(p), F.col(c).cast("string"))


def _graph(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    v = c.filter("c_custkey % 7 <> 0").select(_id("c", "c_custkey").alias("id"), F.col("c_name").alias("name")).union(n.select(_id("n", "n_nationkey"), "n_name")).union(r.select(_id("r", "r_regionkey"), "r_name"))
    e = c.select(_id("c", "c_custkey").alias("src"), _id("cn", "c_custkey").alias("rel"), _id("n", "c_nationkey").alias("dst")).union(n.select(_id("n", "n_nationkey"), _id("nr", "n_nationkey"), _id("r", "n_regionkey")))
    return v, e


@query(f"""with {V}, {E}, both_ as (select src, rel, dst from e union all select dst, rel, src from e), seeds as (select id from v where id in ('n1', 'n3', 'r2', 'c8', 'c14'))
select s.id, b.rel, b.dst as neighbour, case when b.dst is not null then exists (select 1 from v where v.id = b.dst) end as known from seeds s left join both_ b on b.src = s.id""")
def one_hop_subgraph(spark, sf_dir):
    v, e = _graph(spark, sf_dir)
    return g.one_hop(v.filter(F.col("id").isin("n1", "n3", "r2", "c8", "c14")).select("id"), v, e)


@query(f"""with {V}, {E}, both_ as (select src, dst from e union select dst, src from e), h0 as (select 'r2' as id),
h1 as (select distinct dst as id from both_ join h0 on src = id where dst not in (select id from h0)),
h2 as (select distinct dst as id from both_ join h1 on src = id where dst not in (select id from h0) and dst not in (select id from h1))
select id, 0 as hop from h0 union all select id, 1 from h1 union all select id, 2 from h2""")
def two_hop_frontier(spark, sf_dir):
    _, e = _graph(spark, sf_dir)
    return g.frontier(e.filter("dst = 'r2'").select(F.col("dst").alias("id")), e, 2)


@query(f"with {V}, {E} select e.src, e.rel, e.dst, a.name as src_name, b.name as dst_name from e join v a on a.id = e.src join v b on b.id = e.dst")
def edge_endpoints(spark, sf_dir):
    v, e = _graph(spark, sf_dir)
    return g.with_endpoints(e, v).select("src", "rel", "dst", "src_name", "dst_name")


@query(f"with {V}, {E} select src, rel, dst from e where src not in (select id from v) or dst not in (select id from v)")
def dangling_edges(spark, sf_dir):
    v, e = _graph(spark, sf_dir)
    return g.dangling(e, v).select("src", "rel", "dst")


@query(f"with {E}, s as (select 'cn' || c_custkey as rel, c_acctbal / 10000 as score from customer where c_custkey % 5 <> 0) select e.src, e.rel, e.dst, round((greatest(coalesce(score, 0), 0) - 0.4) / 0.6, 6) as weight from e left join s using (rel) where round((greatest(coalesce(score, 0), 0) - 0.4) / 0.6, 6) > 0")
def edge_weight_rescale(spark, sf_dir):
    _, e = _graph(spark, sf_dir)
    s = table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select(_id("cn", "c_custkey").alias("rel"), (F.col("c_acctbal") / 10000).alias("score"))
    return g.edge_weights(e, s, 0.4).select("src", "rel", "dst", "weight")


_NEW = """new_ as (select 'c' || (o_custkey + 100) as id, arg_max(o_orderpriority, o_orderkey) as d from orders group by o_custkey)"""


@query(f"with {V}, {_NEW} select coalesce(v.id, n.id) as id, coalesce(v.name, 'new') as name, coalesce(case when v.id is not null then 'old' end, 'fresh') as type, coalesce(n.d, v.name) as description from v full join new_ n on n.id = v.id")
def graph_upsert_merge(spark, sf_dir):
    v, _ = _graph(spark, sf_dir)
    new = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") + 100).cast("string")).alias("id"), F.lit("new").alias("name"), F.lit("fresh").alias("type"), F.col("o_orderpriority").alias("description"), F.col("o_orderkey").alias("seq"))
    return g.upsert_vertices(v.select("id", "name", F.lit("old").alias("type"), F.col("name").alias("description")), new)


@query(f"""with {V}, {E}, new_ as (select 'cn' || o_custkey as rel, 'c' || o_custkey as src, 'n' || (o_custkey % 30) as dst, o_orderpriority as d, case when o_orderkey % 2 = 0 then (o_orderkey % 9)::varchar else 'strong' end as s, o_orderkey as seq from orders),
ok as (select * from new_ where src in (select id from v) and dst in (select id from v)), last_ as (select * from (select *, row_number() over (partition by rel order by seq desc) as n from ok) where n = 1)
select rel, src, dst, 'seed' as description, 1 as strength from e where rel not in (select rel from last_) union all select rel, src, dst, d, try_cast(s as int) from last_""")
def edge_upsert_merge(spark, sf_dir):
    v, e = _graph(spark, sf_dir)
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    new = o.select(_id("cn", "o_custkey").alias("rel"), _id("c", "o_custkey").alias("src"), F.concat(F.lit("n"), (F.col("o_custkey") % 30).cast("string")).alias("dst"), F.col("o_orderpriority").alias("description"), F.when(key % 2 == 0, (key % 9).cast("string")).otherwise("strong").alias("strength"), key.alias("seq"))
    return g.upsert_edges(e.select("rel", "src", "dst", F.lit("seed").alias("description"), F.lit(1).alias("strength")), new, v)


@query("select distinct o_custkey + 100 as id from orders where o_custkey + 100 not in (select c_custkey from customer)")
def sync_missing_ids(spark, sf_dir):
    return g.missing_ids(table(spark, sf_dir, "orders").select((F.col("o_custkey") + 100).alias("id")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


def _knn_edges(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    near = knn.top_k(e.filter("vec_id % 100 = 0"), e, 5)
    return near.select(F.col("qid").alias("src"), F.col("id").alias("dst"), F.col("score").alias("weight"))


@query(f"""with {COSINE}, ed as (select qid as s, id as d, score as w from near where rank <= 5), e as (select s, d, w from ed union all select d, s, w from ed),
a0 as (select distinct s as id, 0.5 as a from ed where s % 200 = 0), g1 as (select d as id, sum(a * w) as g from a0 join e on e.s = a0.id group by d),
a1 as (select id, least(1.0, coalesce(a, 0) + coalesce(g, 0)) as a from a0 full join g1 using (id)), g2 as (select d as id, sum(a * w) as g from a1 join e on e.s = a1.id group by d)
select id, round(least(1.0, coalesce(a, 0) + coalesce(g, 0)), 6)::double as activation from a1 full join g2 using (id)""")
def spreading_activation_sync(spark, sf_dir):
    e = _knn_edges(spark, sf_dir)
    return g.activation_sync(e.filter("src % 200 = 0").select(F.col("src").alias("id"), F.lit(0.5).alias("activation")).distinct(), e, 2)


@query()
def spreading_activation(spark, sf_dir):
    e = _knn_edges(spark, sf_dir)
    near = e.withColumn("question", F.col("src"))
    seeds = e.select(F.col("src").alias("question"), F.col("src").alias("id"), F.lit(0.9).alias("activation")).distinct()
    return g.spreading_activation(seeds, near.withColumn("weight", F.least(F.lit(1.0), F.col("weight") + 0.5)))


@query("select user_id, 's' || (event_id % 50) || ':' || event_id as summary_id, 's' || (event_id % 50) as session_id, event_id::varchar as message_id, (row_number() over (partition by user_id order by event_id) - 1)::int as ts from events")
def prov_explode(spark, sf_dir):
    sid = F.concat(F.lit("s"), (F.col("event_id") % 50).cast("string"), F.lit(":"), F.col("event_id").cast("string"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", sid.alias("sid"), F.col("ts").cast("string").alias("at")))).alias("ev"))
    flat = rows.select("user_id", F.col("ev.sid").alias("ids"), F.col("ev.at").alias("dates"))
    return prov.explode_events(prov.events_from_flat(flat, "ids", "dates"), "user_id").select("user_id", "summary_id", "session_id", "message_id", "ts")


@query("""with e as (select user_id, 's' || (event_id % 20) as session_id, event_type as message_id, event_type || ':' || (event_id % 20) as summary_id, event_id, (event_id % 7)::int as ts from events),
k as (select * from (select *, row_number() over (partition by user_id, session_id, message_id, summary_id order by event_id desc) as r from e) where r = 1)
select user_id, summary_id, event_id, row_number() over (partition by user_id order by ts, summary_id) as n from k""")
def prov_merge_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("s"), (F.col("event_id") % 20).cast("string")).alias("session_id"), F.col("event_type").alias("message_id"), F.concat("event_type", F.lit(":"), (F.col("event_id") % 20).cast("string")).alias("summary_id"), "event_id", (F.col("event_id") % 7).cast("int").alias("ts"))
    return prov.merge_events(e, "user_id", "event_id").select("user_id", "summary_id", "event_id", F.col("n").cast("long").alias("n"))


@query("select user_id, event_type, event_id, round(value, 4) as value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1")
def upsert_latest_by_key(spark, sf_dir):
    return prov.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


@query("""with f as (select l_suppkey, l_partkey, l_orderkey, l_returnflag as d from lineitem),
first_ as (select l_suppkey, l_partkey, d, min(l_orderkey * 10 + case d when 'A' then 1 when 'N' then 2 else 3 end) as o from f group by all)
select l_suppkey as sid, l_partkey as tid, string_agg(d, '; ' order by o) as description, (select count(*) from f where f.l_suppkey = first_.l_suppkey and f.l_partkey = first_.l_partkey) as n_merged from first_ group by l_suppkey, l_partkey""")
def rel_pair_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sid"), F.col("l_partkey").alias("tid"), F.col("l_orderkey").alias("o"), F.col("l_returnflag").alias("description"))
    return prov.merge_pairs(rows, ["sid", "tid"], "description", "o")


@query("select doc_id, lang || '_' || source || '_' || doc_id as entity_id, source || '_' || lang as rel_id from documents")
def slug_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.entity_id(F.upper("lang"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))).alias("entity_id"), tx.relation_id(F.concat(F.lit(" "), F.col("source")), F.concat(F.upper("lang"), F.lit(" "))).alias("rel_id"))
