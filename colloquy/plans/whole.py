"""The whole way from questions to contexts, over a knowledge base made of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import settings
from colloquy.operators import bm25, contexts
from colloquy.plans.catalogue import query
from colloquy.plans.expanding import _bm25_sql
from colloquy.plans.retrieval import letters, sql_letters, sql_tokens
from colloquy.sources import store
from colloquy.sources.tables import table

PLAN = contexts.Plan(settings.Search(entity_topk=8, relation_topk=5), settings.Activation(hops=1), settings.Evidence(summary_topk=12, direct_topn=6, direct_least=0.5))


def knowledge(spark, sf_dir) -> contexts.Knowledge:
    """Parts are entities, their sales by supplier number relations, documents of their number sources."""
    p, d = table(spark, sf_dir, "part"), table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    entities = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("description"), none.alias("mentioned_at"), letters(F.col("p_name")).alias("embedding"))
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg((F.max("l_quantity") / 50).alias("weight"))
    named = sold.join(p.select(F.col("p_partkey").alias("src"), F.col("p_name").alias("label"), letters(F.col("p_name")).alias("embedding")), "src")
    # several steps read the relations and the vectors of the documents, which are made once
    relations = store.written(named.select((F.col("src") * 1_000_000 + F.col("dst")).alias("id"), "src", "dst", "label", "weight", "embedding"), "relations")
    summaries = store.written(bm25.spread(d.select("doc_id", "lang", "text")).select(F.col("doc_id").alias("sid"), F.col("lang").alias("at"), "text", letters(F.col("text")).alias("embedding")), "summaries")
    return contexts.Knowledge(entities, bm25.build(p.select(F.col("p_partkey").alias("id"), "p_name"), "id", "p_name"), relations, p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("sid")), summaries)


def questions(spark, sf_dir):
    """One of each brand, about two of its parts."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").cast("long").alias("question"), F.concat(F.lit("which "), F.min("p_name"), F.lit(" or "), F.max("p_name"), F.lit(" is cheap")).alias("text")).drop("p_brand")


def _near(name: str, asked: str, items: str, k: int, least: float) -> str:
    """CTE of the k items nearest to each asked vector, those from least on."""
    return f"""{name} as (select * from (select *, row_number() over (partition by q order by score desc, id) as r from (
  select a.q, i.id, round(list_dot_product(a.v, i.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(i.v, i.v)), 6) as score from {asked} a, {items} i where list_dot_product(a.v, a.v) > 0 and list_dot_product(i.v, i.v) > 0)) where r <= {k} and score >= {least})"""


def _overlap(name: str) -> str:
    return f"case when len(terms) = 0 then 0.0 else len(list_filter(terms, lambda w: list_contains({sql_tokens(name)}, w))) / len(terms) end * 10 - 5"


@query(f"""with asked_ as (select min(p_partkey)::bigint as q, 'which ' || min(p_name) || ' or ' || max(p_name) || ' is cheap' as text from part group by p_brand),
qs as (select q, text, list_distinct({sql_tokens("text")}) as terms, {sql_letters("text")} as v from asked_),
ent as (select p_partkey as id, p_name as name, p_type as type, p_brand as description, {sql_letters("p_name")} as v from part),
rel as (select src * 1000000 + dst as id, src, dst, p_name as label, weight, {sql_letters("p_name")} as v from (select l_partkey as src, l_suppkey as dst, max(l_quantity) / 50 as weight from lineitem group by all) join part on p_partkey = src),
summ as (select doc_id as id, lang as place, text, {sql_letters("text")} as v from documents where trim(text) <> ''),
asked as (select q, term, count(*) as qtf from (select q, unnest({sql_tokens("text")}) as term from asked_) group by all),
{_bm25_sql("n", "p_partkey", "p_name", "part", "asked")},
lex as (select q, id from (select *, row_number() over (partition by q order by score desc, id) as r from (select *, max(score) over (partition by q) as best from n_sc) where best > 0 and score >= best * 0.6) where r <= 8),
{_near("dense", "qs", "ent", 8, 0.2)}, seed as (select q, id from lex union select q, id from dense),
e1 as (select src, dst, round((weight - 0.4) / 0.6, 6) as w from rel where round((weight - 0.4) / 0.6, 6) > 0), e2 as (select src as id, dst as too, w from e1 union all select dst, src, w from e1),
gain as (select q, too as id, sum(w) as g from seed join e2 using (id) group by all),
act as (select q, id from gain where round(g, 6) > 0.5 union select q, id from seed),
bynode as (select distinct a.q, r.id from rel r join act a on a.id = r.src join act b on b.id = r.dst and b.q = a.q),
words as (select q, unnest(terms) as word from qs), wv as (select word as q, {sql_letters("word")} as v from (select distinct word from words)), {_near("hit", "wv", "rel", 5, 0.2)},
byword as (select distinct w.q, hit.id from words w join hit on hit.q = w.word),
edges as (select b.q, b.id from bynode b where exists (select 1 from byword w where w.q = b.q and w.id = b.id) or not exists (select 1 from byword w where w.q = b.q)),
ke as (select * from (select q, e.*, row_number() over (partition by q order by round({_overlap("e.name")}, 6) desc, e.id) as rank from act join ent e using (id) join qs using (q)) where rank <= 10),
kr as (select * from (select q, r.id, r.label, row_number() over (partition by q order by round({_overlap("r.label")}, 6) desc, r.id) as rank from edges join rel r using (id) join qs using (q)) where rank <= 10),
{_near("direct", "qs", "summ", 6, 0.5)},
sids as (select q, id from ke union select q, id from direct),
scored as (select q, s.id, s.place, s.text, coalesce(round(list_dot_product(qs.v, s.v) / sqrt(nullif(list_dot_product(qs.v, qs.v) * list_dot_product(s.v, s.v), 0)), 6), 0) as score from sids join summ s using (id) join qs using (q)),
best as (select *, row_number() over (partition by q order by score desc, id) as pos from scored),
over_ as (select b.*, len(list_filter(qs.terms, lambda w: contains(lower(b.text), w))) as overlap, max(len(list_filter(qs.terms, lambda w: contains(lower(b.text), w)))) over (partition by q) >= 1 as some_ from best b join qs using (q) where pos <= 12),
piece as (select * from (select *, row_number() over (partition by q order by overlap desc, pos) as r from over_ where not some_ or overlap >= 1) where r <= 8),
block as (select q, string_agg('  • [' || place || '][sid=' || id || '][score=' || printf('%.3f', score) || '] ' || text, chr(10) order by pos) as block from piece group by q),
el as (select q, string_agg('- ' || name || ' (' || type || '): ' || description, chr(10) order by rank) as e from ke group by q), rl as (select q, string_agg('- ' || label, chr(10) order by rank) as r from kr group by q),
shown as (select q, '=== Entities ===' || chr(10) || coalesce(e, '') || chr(10) || '=== Relationships ===' || chr(10) || coalesce(r, '') as shown from el full join rl using (q))
select qs.q as question, concat_ws(chr(10) || '=== Evidence ===' || chr(10), shown, block) as context from qs left join shown using (q) left join block using (q)""")
def question_contexts(spark, sf_dir):
    return contexts.contexts(questions(spark, sf_dir), knowledge(spark, sf_dir), PLAN, letters)
