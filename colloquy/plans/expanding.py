"""Queries over candidate expansion, stored tables and ingestion steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import jsons
from colloquy.functions import text as tx
from colloquy.operators import bm25, expansion, ingest
from colloquy.operators import turns as turn_ops
from colloquy.plans.catalogue import query
from colloquy.plans.dialogue import PAIRS
from colloquy.plans.graphs import E, V, _graph, _id
from colloquy.plans.retrieval import BM25, COSINE, _near, sql_tokens
from colloquy.sources import store
from colloquy.sources.tables import table


@query(f"""with {COSINE}, hits as (select qid // 500 as question, u.label as keyword, n.id, max(n.score) as score from near n join units u on n.id = u.vec_id where rank <= 100 group by all)
select question, keyword, id, score, rank from (select *, row_number() over (partition by question, keyword order by score desc, id) as rank from hits where score >= 0.1) where rank <= 5""")
def relation_keyword_knn(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("keyword"))
    hits = _near(spark, sf_dir, 100).drop("rank").join(labels, "id").groupBy(F.floor(F.col("qid") / 500).alias("question"), "keyword", "id").agg(F.max("score").alias("score"))
    return expansion.per_keyword(hits, "question", "keyword", "id", "score", 5, 0.1)


@query(f"""with {V}, {E}, s as (select 'cn' || c_custkey as rel, c_acctbal / 10000 as score from customer union all select 'nr' || n_nationkey, (n_nationkey % 10) / 10 from nation),
k as (select src, dst from e join s using (rel) where round((greatest(score, 0) - 0.4) / 0.6, 6) > 0), b as (select src, dst from k union select dst, src from k), h0 as (select 'r2' as id union select 'n3'),
h1 as (select distinct dst as id from b join h0 on src = id where dst not in (select id from h0)), s1 as (select id from h0 union select id from h1),
h2 as (select distinct dst as id from b join h1 on src = id where dst not in (select id from s1))
select id, 0 as hop from h0 union all select id, 1 from h1 union all select id, 2 from h2""")
def weighted_frontier(spark, sf_dir):
    _, e = _graph(spark, sf_dir)
    s = table(spark, sf_dir, "customer").select(_id("cn", "c_custkey").alias("rel"), (F.col("c_acctbal") / 10000).alias("score"))
    s = s.union(table(spark, sf_dir, "nation").select(_id("nr", "n_nationkey"), (F.col("n_nationkey") % 10) / 10))
    return expansion.weighted_frontier(spark.createDataFrame([("r2",), ("n3",)], "id string"), e, s, 2, 0.4)


_BRANCHES = "a as (select distinct o_custkey as id from orders where o_orderstatus = 'F'), b as (select distinct o_custkey as id from orders where o_totalprice > 100000)"


def _branches(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id")
    return o.filter("o_orderstatus = 'F'"), o.filter("o_totalprice > 100000")


@query(f"with {_BRANCHES} select id from a union select id from b")
def subgraph_union(spark, sf_dir):
    return expansion.merged_ids(*_branches(spark, sf_dir), "id")


@query(f"with {_BRANCHES} select id from a intersect select id from b")
def subgraph_intersection(spark, sf_dir):
    return expansion.merged_ids(*_branches(spark, sf_dir), "id", intersect=True)


@query("""with f as (select user_id as g, event_type || (event_id % 4) as k, 0 as p, event_id as o from events where event_type = 'view'), t as (select user_id, event_type || (event_id % 4), 1, event_id from events where value > 30),
u as (select g, k, p, min(o) as o from (select * from f union all select * from t) group by all), m as (select g, k, min(p) as p from u group by all)
select g, k, row_number() over (partition by g order by p, o, k) as place from m join u using (g, k, p)""")
def seed_union_activated(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), F.concat("event_type", (F.col("event_id") % 4).cast("string")).alias("k"), F.col("event_id").alias("o"), "event_type", "value")
    return expansion.ordered_union(e.filter("event_type = 'view'"), e.filter("value > 30"), "g", "k", "o")


@query("""with k as (select doc_id, [lang, source] as h, case when doc_id % 4 = 0 then null else [source, lang || source] end as l from documents)
select doc_id, array_to_string(h, ',') as high, array_to_string(coalesce(l, []), ',') as low, array_to_string(case when l is null then h else [h[1], h[2], l[2]] end, ',') as "both" from k""")
def keyword_modes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    h, w = F.array("lang", "source"), F.when(F.col("doc_id") % 4 != 0, F.array("source", F.concat("lang", "source")))
    return d.select("doc_id", *(F.array_join(expansion.keyword_union(h, w, m), ",").alias(m) for m in ("high", "low", "both")))


@query(f"""with {V}, {E}, wanted as (select distinct 'c' || (o_custkey + 20) as id from orders), f as (select v.id, v.name, [e.dst] as n from v join e on e.src = v.id),
c as (select 'c' || c_custkey as id, upper(c_name) as name from customer)
select id, name, n[1] as neighbour, 'graph' as source from f where id in (select id from wanted) union all select w.id, c.name, null, 'cache' from wanted w join c using (id) where w.id not in (select id from f)""")
def cache_fallback_join(spark, sf_dir):
    v, e = _graph(spark, sf_dir)
    found = v.join(e.select(F.col("src").alias("id"), "dst"), "id").groupBy("id", "name").agg(F.collect_list("dst").alias("neighbours"))
    wanted = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") + 20).cast("string")).alias("id"))
    cache = table(spark, sf_dir, "customer").select(_id("c", "c_custkey").alias("id"), F.upper("c_name").alias("name"))
    got = expansion.with_cache(wanted, found, cache, "id")
    return got.select("id", "name", F.get("neighbours", F.lit(0)).alias("neighbour"), "source")


@query("""with m as (select c_nationkey as k, arg_min(c_name, (c_mktsegment, c_name)) as name, min(c_mktsegment) as kind from customer where c_nationkey <> 3 group by 1)
select s_suppkey, s_nationkey::bigint as k, name, kind from supplier left join m on k = s_nationkey""")
def id_metadata_join(spark, sf_dir):
    m = table(spark, sf_dir, "customer").filter("c_nationkey <> 3").select(F.col("c_nationkey").cast("long").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))
    return expansion.with_metadata(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("k")), m, "k")


@query("""select c_custkey, coalesce(case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then c_name end, case when c_custkey % 6 <> 0 then upper(c_name) end, 'c' || c_custkey) || ' -> ' ||
coalesce(n_name, '?') || case when c_custkey % 2 = 0 then ' | ' || c_mktsegment else '' end as label from customer left join (select * from nation where n_nationkey % 5 <> 0) on n_nationkey = c_nationkey""")
def relation_labels(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 0")
    i, none = F.col("c_custkey"), F.lit(None).cast("string")
    both = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    label = expansion.relation_label(F.when(i % 3 == 0, "  ").when(i % 3 == 1, F.col("c_name")), F.when(i % 6 != 0, F.upper("c_name")), F.concat(F.lit("c"), i.cast("string")), F.col("n_name"), none, F.lit(""), F.when(i % 2 == 0, F.col("c_mktsegment")).otherwise(" "))
    return both.select("c_custkey", label.alias("label"))


@query(f"""with {COSINE}, pool as (select * from (select qid, id, score, row_number() over (partition by qid order by score desc, id) as n from near where rank <= 60 and score >= 0.1) where n <= 24),
s as (select qid, id from near where rank % 2 = 1 and rank <= 20), w as (select * from pool p where not exists (select 1 from s where s.qid = p.qid and s.id = p.id))
select qid, id, score, rank from (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from w) where rank <= 8""")
def vector_tool_search(spark, sf_dir):
    near = _near(spark, sf_dir, 60)
    return expansion.search_beyond(near.drop("rank"), near.filter("rank % 2 = 1 and rank <= 20"), "qid", "id", "score", 8, 0.1)


@query("""with n as (select o_custkey as g, coalesce(case when c_custkey % 4 <> 0 then c_mktsegment end, o_orderkey::varchar) as name, o_orderkey as o from orders left join customer on c_custkey = o_orderkey),
f as (select g, name, min(o) as o from n group by all) select g, string_agg(name, ',' order by o) as names from f group by g""")
def trace_names(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("name"))
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("o"))
    return expansion.names_of(ids, names, "g", "k", "o").select("g", F.array_join("names", ",").alias("names"))


@query("select user_id, event_id, place from (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as place from events) where place <= 8")
def evidence_cap(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("order", F.struct(-F.col("value"), "event_id"))
    return expansion.capped(e, "user_id", "order", 8).select("user_id", "event_id", "place")


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as place from orders where o_orderstatus = 'O'")
def candidates_by_id(spark, sf_dir):
    return expansion.by_id(table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


# ---- lexical search over fields, stored postings and turns ----------------------------------

_TOK = sql_tokens("{}")


def _bm25_sql(name: str, key: str, col: str, source: str, asked: str) -> str:
    """CTEs of one index and its scores."""
    return f"""
{name}_t as (select {key} as id, {sql_tokens(col)} as t from {source}), {name}_p as (select id, len(t) as dl, unnest(t) as term from {name}_t),
{name}_tf as (select id, dl, term, count(*) as tf from {name}_p group by all), {name}_s as (select count(*) as n, avg(len(t)) as avgdl from {name}_t),
{name}_raw as (select term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from {name}_tf, {name}_s group by term),
{name}_idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from {name}_raw) else raw end as idf from {name}_raw),
{name}_sc as (select q, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from {name}_tf join {asked} using (term) join {name}_idf using (term), {name}_s group by q, id)"""


_ASKED = f"asked as (select q, term, count(*) as qtf from (select item_id as q, unnest({sql_tokens('text')}) as term from benchmark) group by all)"


@query(f"with {_ASKED}, {_bm25_sql('a', 'doc_id', 'text', 'documents', 'asked')}, {_bm25_sql('b', 'doc_id', 'source', 'documents', 'asked')}, {_bm25_sql('c', 'doc_id', 'reverse(text)', 'documents', 'asked')} select q, id, max(score) as score from (select * from a_sc union all select * from b_sc union all select * from c_sc) group by q, id")
def bm25_two_fields(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", F.reverse("text").alias("back"))
    return bm25.field_scores(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "q"), "q", "text", d, "id", ["text", "source", "back"])


@query(f"with asked as (select q, term, count(*) as qtf from (select conv_id as q, unnest({sql_tokens('text')}) as term from conversations where turn = 0) group by all), {_bm25_sql('a', 'conv_id * 1000 + turn', 'text', 'conversations', 'asked')} select q, id, score, rank from (select *, row_number() over (partition by q order by score desc, id) as rank from a_sc) where rank <= 5")
def bm25_over_turns(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("q"), "turn", "text")
    return bm25.build(t, "id", "text").best(t.filter("turn = 0"), "q", "text", 5)


@query(f"with {BM25} select item_id, doc_id, score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored) where rank <= 5")
def bm25_persisted(spark, sf_dir):
    """Postings are published, read back, and the index is opened anew from them."""
    s = store.Store(spark, store.shared_dir(spark, "index"))
    built = bm25.build(table(spark, sf_dir, "documents"), "doc_id", "text")
    s.publish("postings", built.posted, valid=lambda p: not p.filter("term is null").isEmpty())
    s.verify("postings")
    index = bm25.opened(s.read("postings"), "doc_id")
    return bm25.top(index.scores(table(spark, sf_dir, "benchmark"), "item_id", "text"), "item_id", "doc_id", 5)


@query("""with t as (select event_id, 'met on ' || strftime(ts, '%Y-%m-%d') || ' and ' || month(ts) || '/' || day(ts) || ' the ' || event_type || ' 7' as s from events)
select event_id, 'met ' || strftime(ts, '%Y-%m-%d') || ' ' || month(ts) || '/' || day(ts) || ' ' || event_type as tokens from events""")
def dated_tokens(spark, sf_dir):
    ts = F.col("ts")
    text = F.concat(F.lit("met on "), F.date_format(ts, "yyyy-MM-dd"), F.lit(" and "), F.date_format(ts, "M/d"), F.lit(" the "), "event_type", F.lit(" 7"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(tx.dated_tokens(text), " ").alias("tokens"))


# ---- stored tables -------------------------------------------------------------------------


@query("select c_custkey as id, case when c_custkey % 10 = 3 then 'changed' else c_name end as name from customer where c_custkey % 7 <> 0")
def vector_update_delete(spark, sf_dir):
    """Rows are published, some updated (unknown ids are not added), some deleted, and the table rebuilt."""
    s = store.Store(spark, store.shared_dir(spark, "vectors"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s.publish("vectors", c)
    s.update("vectors", c.filter("id % 10 = 3").select("id", F.lit("changed").alias("name")).union(c.select(F.col("id") + 10_000_000, F.lit("new"))), "id")
    s.delete("vectors", c.filter("id % 7 = 0"), "id")
    s.publish("vectors", s.read("vectors"))
    s.verify("vectors")
    return s.read("vectors")


@query(f"with {V}, {E} select 'edges' as name, src || '>' || dst as what from e union all select 'nodes', id from v")
def graph_clear_restore(spark, sf_dir):
    """Both tables go into a snapshot, are cleared, and come back from it."""
    root = store.shared_dir(spark, "graph")
    s = store.Store(spark, root)
    v, e = _graph(spark, sf_dir)
    s.publish("nodes", v)
    s.publish("edges", e)
    s.snapshot(f"{root}/snapshots/1", ["nodes", "edges"], model="none")
    s.clear("nodes")
    s.clear("edges")
    if s.read("nodes").count() or s.read("edges").count():
        raise ValueError("the graph is not empty")
    s.restore(f"{root}/snapshots/1", model="none")
    return s.read("edges").select(F.lit("edges").alias("name"), F.concat("src", F.lit(">"), "dst").alias("what")).union(s.read("nodes").select(F.lit("nodes"), "id"))


@query("select p_partkey, p_name from part")
def index_swap_rollback(spark, sf_dir):
    """A new version that lacks rows is refused; one that is taken can be rolled back."""
    s = store.Store(spark, store.shared_dir(spark, "swap"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n = s.publish("part", p)["rows"]
    try:
        s.publish("part", p.filter("p_partkey % 2 = 0"), valid=lambda d: d.count() == n)
    except ValueError:
        pass
    else:
        raise ValueError("a version that lacks rows was taken")
    s.publish("part", p.limit(0))
    s.rollback("part")
    return s.read("part")


@query("select 'orders' as name, (select count(*) from orders) as n, true as whole union all select 'customer', (select count(*) from customer), true")
def snapshot_validation(spark, sf_dir):
    s = store.Store(spark, store.shared_dir(spark, "snap"))
    cold = s.is_cold("orders", "customer")
    for name in ("orders", "customer"):
        s.publish(name, table(spark, sf_dir, name))
    s.verify("orders", "customer")
    whole = cold and not s.is_cold("orders", "customer")
    return spark.createDataFrame([(n, s.current(n)["rows"], whole) for n in ("orders", "customer")], "name string, n long, whole boolean")


# ---- ingestion steps -----------------------------------------------------------------------


@query(f"""with {PAIRS}, r as (select conv_id, message_id, 'User: ' || user_text || case when trim(assistant_text) = '' then '' else chr(10) || 'Assistant: ' || assistant_text end as raw_text from pairs)
select conv_id || ':' || message_id as sid, raw_text, array_to_string(string_split_regex(trim(raw_text), '\\s+')[1:12], ' ') as summary from r""")
def turn_summaries(spark, sf_dir):
    from colloquy.functions import models

    p = turn_ops.turn_pairs(table(spark, sf_dir, "conversations")).withColumn("sid", F.concat_ws(":", "conv_id", "message_id"))
    return ingest.turn_summaries(p, "sid", "user_text", "assistant_text", lambda c: models.compressed(c, 12))


_STEP = "d as (select doc_id, source, lang, doc_id % 3 as k from documents)"


def _answers(spark, sf_dir):
    k = F.col("doc_id") % 3
    one = F.when(k == 0, F.lit("nothing to see")).when(k == 1, F.concat(F.lit('("entity"<|>'), "source", F.lit('<|>PERSON<|>a "b")##("entity"<|>'), "lang", F.lit("<|>tongue)##(broken<|>x)##<|COMPLETE|>tail")))
    one = one.otherwise(F.concat(F.lit('(entity<|>"'), "source", F.lit('"<|>place<|> spaced )##("entity"<|><|>person<|>no name)##("ENTITY"<|>'), "lang", F.lit("<|>")))
    two = F.concat(F.lit('("relationship"<|>'), "source", F.lit("<|>"), "lang", F.lit('<|>in<|>k)##("relationship"<|>'), "lang", F.lit('<|>ghost<|>lost)##("relationship"<|>'), "source", F.lit(")"))
    return table(spark, sf_dir, "documents").select("doc_id", one.alias("first"), two.alias("second"))


@query(f"""with {_STEP} select doc_id, 'entity' as kind, source as a, case k when 1 then 'Person' else 'Place' end as b, case k when 1 then 'a "b' else 'spaced' end as c from d where k > 0
union all select doc_id, 'entity', lang, case k when 1 then 'Tongue' else '' end, case k when 1 then lang else lang end from d where k > 0
union all select doc_id, 'relation', source, lang, 'in' from d where k > 0""")
def two_step_extract(spark, sf_dir):
    found, rel = ingest.two_steps(_answers(spark, sf_dir), "doc_id", "first", "second")
    return found.select("doc_id", F.lit("entity").alias("kind"), F.col("name").alias("a"), F.col("type").alias("b"), F.col("description").alias("c")).union(rel.select("doc_id", F.lit("relation"), "source", "target", "description"))


@query("""select event_id, 0::bigint as n, event_type as name, case when event_id % 2 = 0 then null else 'u' || user_id end as target, 'd' || event_id as description from events where event_id % 5 <> 0
union all select event_id, 2, 'second', null, 'x|y' from events where event_id % 5 <> 0""")
def operation_blocks(spark, sf_dir):
    i = F.col("event_id")
    target = F.when(i % 2 == 0, "NULL").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    block = F.concat(F.lit("so\n===BEGIN===\n "), "event_type", F.lit("||t||UPDATE||"), target, F.lit("||c||ct||d"), i.cast("string"), F.lit(" \ntoo||few\nsecond||t||ADD||NULL||c||ct||x|y||more\n===END=== after"))
    text = F.when(i % 5 == 0, F.concat(F.lit("===BEGIN=== a||b||c||d||e||f||g "), i.cast("string"))).otherwise(block)
    got = ingest.operation_block(table(spark, sf_dir, "events").select("event_id", text.alias("t")), "event_id", "t")
    return got.select("event_id", F.col("n").cast("long").alias("n"), F.col("input_name").alias("name"), F.col("target_existing_id").alias("target"), F.col("merged_description").alias("description"))


@query("""with k as (select 'c' || c_custkey as id, c_name as name, c_mktsegment as type, 'old' as description, ['p0'] as prov from customer where c_custkey % 2 = 0),
o as (select o_orderkey as seq, case when o_orderkey % 3 = 0 then 'new' || (o_custkey % 50) else 'c' || o_custkey end as id, o_orderpriority as description, 'p' || (o_orderkey % 5) as p from orders),
every as (select id, -1 as seq, name, type, description, unnest(prov) as p from k union all select id, seq, 'N' || id, 'T', description, p from o)
select id, arg_min(name, seq) as name, arg_min(type, seq) as type, arg_max(description, seq) as description, array_to_string(list_sort(list(distinct p)), ',') as prov from every group by id""")
def apply_operations(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(_id("c", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.lit("old").alias("description"), F.array(F.lit("p0")).alias("prov"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    fresh = F.concat(F.lit("new"), (cust % 50).cast("string"))
    ops = table(spark, sf_dir, "orders").select(
        key.alias("seq"), F.when(key % 3 == 0, fresh).otherwise(_id("c", "o_custkey")).alias("id"), F.lit("T").alias("type"), F.col("o_orderpriority").alias("description"), F.array(F.concat(F.lit("p"), (key % 5).cast("string"))).alias("prov"),
        F.when(key % 3 != 0, _id("c", "o_custkey")).alias("target"),
    ).withColumn("name", F.concat(F.lit("N"), "id"))
    return ingest.apply_operations(known, ops).withColumn("prov", F.array_join("prov", ","))


@query("select doc_id, case when doc_id % 3 = 0 then lang else source end as name, case when doc_id % 3 = 0 then 2 else 1 end as attempt from documents")
def fallback_ingest(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    record = lambda c: F.concat(F.lit('("entity"<|>'), c, F.lit("<|>person<|>x)"))
    rows = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "sorry").otherwise(record("source")).alias("primary"), record("lang").alias("raw"))
    got = ingest.with_fallback(rows, "doc_id", "primary", "raw")
    ingest.require_all(rows, got, "doc_id")
    return got.select("doc_id", "name", "attempt")


# ---- JSON of unknown shape -----------------------------------------------------------------


@query("""select event_id, event_type || ',x,deep' as strings, (event_id % 7) || ',' || json_extract_string(props, '$.k') || ',3' as ints, '{"a":{"d":["x",{"e":"deep","f":3}],"k":' || json_extract_string(props, '$.k') || '},"b":' || (event_id % 7) || ',"c":"' || event_type || '"}' as compact,
case when event_id % 2 = 0 then json_extract_string(props, '$.k')::double end as k from events""")
def json_leaves(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{ "c" : "'), "event_type", F.lit('", "b": '), (F.col("event_id") % 7).cast("string"), F.lit(', "a": {"k": '), k, F.lit(', "d": ["x", {"f": 3, "e": "deep"}]} }'))
    picked = F.when(F.col("event_id") % 2 == 0, jsons.dotted(F.col("j"), "a.k")).otherwise(jsons.dotted(F.col("j"), "a.none"))
    made = e.select("event_id", text.alias("j")).select("event_id", jsons.flattened("j").alias("l"), jsons.compact(F.col("j")).alias("compact"), picked.alias("k"))
    by_place = F.transform("l.ints", lambda x: x.cast("string"))
    return made.select("event_id", F.concat_ws(",", "l.strings").alias("strings"), F.array_join(by_place, ",").alias("ints"), "compact", "k")


@query("select event_id, event_type as name, value as score, null::varchar as missing, case when event_id % 10 = 0 then 'n/a' else printf('%.4f', (event_id % 4) / (event_id % 10)) end as share, '| ' || event_id || ' | a\\|' || event_type || ' |  |' as line from events")
def case_rows(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    j = F.to_json(F.struct(F.struct(F.col("event_type").alias("name"), F.struct(F.col("value").alias("score")).alias("s")).alias("case")))
    name, score, missing = jsons.case_row(j, {"name": "case.name", "score": "case.s.score", "missing": "case.t.score"})
    line = jsons.table_row(i, F.concat(F.lit("a|"), "event_type"), F.lit(None).cast("string"))
    return e.select("event_id", name, score.cast("double").alias("score"), missing, jsons.ratio(i % 4, i % 10).alias("share"), line.alias("line"))
