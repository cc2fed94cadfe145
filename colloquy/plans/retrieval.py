"""Queries over documents, benchmark and embeddings: lexical and vector search, candidates, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.functions import vector as vec
from colloquy.operators import bm25, bm25_store, knn, ranking, vector_index
from colloquy.operators import turns as turn_ops
from colloquy.plans.catalogue import query
from colloquy.sources import store
from colloquy.sources.tables import table

_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


def sql_tokens(col: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({col}, '')), '[a-z]+'), lambda w: length(w) >= 3 and w not in ({_STOP}))"


POSTINGS = f"""
toks as (select doc_id, {sql_tokens("text")} as t from documents),
terms as (select doc_id, len(t) as dl, unnest(t) as term from toks),
posted as (select doc_id, dl, term, count(*) as tf from terms group by all)"""
BM25 = f"""
{POSTINGS},
stats as (select count(*) as n, avg(len(t)) as avgdl from toks),
raw as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from posted, stats group by term),
idf as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
asked as (select item_id, term, count(*) as qtf from (select item_id, unnest({sql_tokens("text")}) as term from benchmark) group by all),
scored as (
  select item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from posted join asked using (term) join idf using (term), stats group by item_id, doc_id)"""
COSINE = """
units as (select vec_id, label, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as len from embeddings),
sims as (
  select q.vec_id as qid, c.vec_id as id, round(list_dot_product(q.v, c.v) / (q.len * c.len), 6) as score
  from units q, units c where q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
near as (select *, row_number() over (partition by qid order by score desc, id) as rank from sims)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.scores(table(spark, sf_dir, "benchmark"), "item_id", "text", table(spark, sf_dir, "documents"), "doc_id", "text")


def _near(spark: SparkSession, sf_dir: str, k: int, threshold: float | None = None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return knn.top_k(e.filter("vec_id % 100 = 0"), e, k, threshold=threshold)


@query(f"select doc_id, len(t)::bigint as n_tokens, array_to_string(t[1:5], ' ') as first_tokens from (select doc_id, {sql_tokens('text')} as t from documents)")
def tokenize_terms(spark, sf_dir):
    t = tx.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(F.slice(t, 1, 5), " ").alias("first_tokens"))


@query(f"with {POSTINGS} select doc_id, term, tf, dl::bigint as dl from posted")
def doc_term_freq(spark, sf_dir):
    return bm25.postings(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "term", "tf", F.col("dl").cast("long").alias("dl"))


@query(f"with {POSTINGS} select term, count(*) as df from posted group by term")
def doc_frequency(spark, sf_dir):
    return bm25.document_frequency(bm25.postings(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query(f"with {BM25} select item_id, doc_id, score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored) where rank <= 10")
def bm25_topk(spark, sf_dir):
    return bm25.top(_scored(spark, sf_dir), "item_id", "doc_id", 10)


@query(f"with {BM25}, best as (select *, max(score) over (partition by item_id) as best from scored) select item_id, doc_id, score from best where best > 0 and score >= 0.6 * best")
def bm25_relative_threshold(spark, sf_dir):
    return bm25.relative_cutoff(_scored(spark, sf_dir), "item_id", rounded=False).select("item_id", "doc_id", "score")


@query(f"with {COSINE} select qid, id, score, rank from near where rank <= 10")
def cosine_topk(spark, sf_dir):
    return _near(spark, sf_dir, 10)


@query(f"with {COSINE} select qid, id, score, rank from near where rank <= 50 and score >= 0.3")
def cosine_threshold(spark, sf_dir):
    return _near(spark, sf_dir, 50, 0.3)


@query(f"with {COSINE} select qid, count(*) as n, round(max(score), 6) as best, round(min(score), 6) as worst from near where rank <= 20 group by qid")
def knn_batch_join(spark, sf_dir):
    return _near(spark, sf_dir, 20).groupBy("qid").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"), F.round(F.min("score"), 6).alias("worst"))


@query(f"""with {COSINE}, hits as (select n.qid, u.label as key, n.id, n.id % 5 as richness, n.score from near n join units u on n.id = u.vec_id where rank <= 50),
  kept as (select *, row_number() over (partition by qid, key order by richness desc, score desc, id) as n from hits)
select qid, key, id, richness, score, row_number() over (partition by qid order by score desc, key) as rank from kept where n = 1""")
def knn_dedup_best(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("key"))
    hits = _near(spark, sf_dir, 50).drop("rank").join(labels, "id").withColumn("richness", F.col("id") % 5)
    return ranking.dedup_best(hits.sort("qid", "id"), "qid", "key", "richness", "score").select("qid", "key", "id", "richness", "score", "rank")


@query("""with l as (select vec_id, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n, embedding::double[] as v from embeddings)
select vec_id, round(n, 4) as length, round(v[1] / greatest(n, 1e-12), 5) as first, round(v[64] / greatest(n, 1e-12), 5) as last from l""")
def l2_normalize(spark, sf_dir):
    u = vec.unit(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vec.norm(F.col("embedding")), 4).alias("length"), F.round(u[0], 5).alias("first"), F.round(u[63], 5).alias("last"))


@query("""with p as (select a.vec_id as qid, a.vec_id + 7 as id, a.embedding::double[] as x from embeddings a)
select qid, id, round(list_dot_product(x, b.embedding::double[]) / sqrt(list_dot_product(x, x) * list_dot_product(b.embedding::double[], b.embedding::double[])), 6) as score
from p left join embeddings b on b.vec_id = p.id""")
def point_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return knn.point_scores(e.select(F.col("vec_id").alias("qid"), (F.col("vec_id") + 7).alias("id")), e, e)


_HYBRID = f"""
with {BM25}, {COSINE.strip()},
lex as (select item_id as question, doc_id as id, 'lexical' as channel from (select *, row_number() over (partition by item_id order by score desc, doc_id) as r from scored) where r <= 10),
dense as (select (qid // 100)::bigint as question, id, 'dense' as channel from near where rank <= 10 and score >= 0.2),
every as (select * from lex union all select * from dense)"""


def _channels(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lex = bm25.top(_scored(spark, sf_dir), "item_id", "doc_id", 10).select(F.col("item_id").alias("question"), F.col("doc_id").alias("id"), F.lit("lexical").alias("channel"))
    dense = _near(spark, sf_dir, 10, 0.2).select(F.floor(F.col("qid") / 100).alias("question"), "id", F.lit("dense").alias("channel"))
    return lex, dense


@query(f"{_HYBRID} select question, id, string_agg(channel, '+' order by channel) as channels from every group by question, id")
def hybrid_union_candidates(spark, sf_dir):
    lex, dense = _channels(spark, sf_dir)
    return lex.union(dense).groupBy("question", "id").agg(F.array_join(F.sort_array(F.collect_list("channel")), "+").alias("channels"))


@query(f"""with {BM25}, {COSINE.strip()},
lex as (select item_id as question, doc_id as id from (select *, row_number() over (partition by item_id order by score desc, doc_id) as r from scored) where r <= 100),
dense as (select (qid // 100)::bigint as question, id from near where rank <= 100)
select question, id from lex intersect select question, id from dense""")
def candidate_intersection(spark, sf_dir):
    lex = bm25.top(_scored(spark, sf_dir), "item_id", "doc_id", 100).select(F.col("item_id").alias("question"), F.col("doc_id").alias("id"))
    return lex.intersect(_near(spark, sf_dir, 100).select(F.floor(F.col("qid") / 100).alias("question"), "id"))


@query(f"{_HYBRID} select question, id from dense d where not exists (select 1 from lex l where l.question = d.question and l.id = d.id)")
def direct_minus_provenance(spark, sf_dir):
    lex, dense = _channels(spark, sf_dir)
    return dense.select("question", "id").join(lex.select("question", "id"), ["question", "id"], "left_anti")


_AUDIT = f"""with {COSINE}, pool as (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank,
    sum(case when score >= 0.25 then 1 else 0 end) over (partition by qid order by score desc, id rows unbounded preceding) as passing from near where rank <= 40),
audit as (select qid, id, score, rank, score >= 0.25 as above_threshold, score >= 0.25 and passing <= 5 as selected,
    case when score >= 0.25 and passing <= 5 then '' when score >= 0.25 then 'topk_cutoff' else 'below_threshold' end as drop_reason from pool)"""


@query(f"{_AUDIT} select * from audit")
def rerank_audit(spark, sf_dir):
    return ranking.rerank_audit(_near(spark, sf_dir, 40).drop("rank"), "qid", "id", "score", 0.25, 5)


@query(f"{_AUDIT} select qid, id, score, rank, miss from (select *, row_number() over (partition by qid order by score desc, rank, id) as miss from audit where not selected) where miss <= 3")
def top_misses(spark, sf_dir):
    audit = ranking.rerank_audit(_near(spark, sf_dir, 40).drop("rank"), "qid", "id", "score", 0.25, 5)
    return ranking.top_misses(audit, "qid", "id", "score").select("qid", "id", "score", "rank", "miss")


@query(f"""with {BM25}, p as (select item_id, doc_id, source, score from scored join documents using (doc_id)),
m as (select *, row_number() over (partition by item_id, source order by score desc, doc_id) <= 1 as guaranteed from p),
n as (select *, sum(guaranteed::int) over (partition by item_id) as sure, row_number() over (partition by item_id, guaranteed order by score desc, doc_id) as n from m)
select item_id, doc_id, source, score, guaranteed, (case when guaranteed then n else sure + n end)::bigint as position from n where guaranteed or n <= 25 - sure""")
def quota_rank_cut(spark, sf_dir):
    p = _scored(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return ranking.quota_cut(store.written(p, "scored"), "item_id", "source", "doc_id", "score", 1, 25).select("item_id", "doc_id", "source", "score", "guaranteed", "position")


@query(f"""with {COSINE}, pool as (select qid, id, score, row_number() over (partition by qid order by score desc, id) as n from near where rank <= 60),
chosen as (select qid, id, score, 'pool' as slot from pool where n <= 5),
extra as (select qid, id, score, 'extra' as slot from near n where rank <= 20 and score >= 0.2 and not exists (select 1 from chosen c where c.qid = n.qid and c.id = n.id))
select *, row_number() over (partition by qid order by score desc, id) as rank from (select * from chosen union all select * from extra)""")
def extra_slot_selection(spark, sf_dir):
    near = _near(spark, sf_dir, 60)
    pool = near.select("qid", "id", "score")
    return ranking.extra_slots(pool, near.filter("rank <= 20").select("qid", "id", "score"), "qid", "id", "score", 5, 0.2)


@query(f"""with {COSINE}, pool as (select qid, id, score, rank as pool_rank, (id * 7919) % 1000 as logit from near where rank <= 40)
select * from (select *, row_number() over (partition by qid order by logit desc, pool_rank) as rank from pool) where rank <= 16""")
def pool_cap_then_rerank(spark, sf_dir):
    pool = _near(spark, sf_dir, 60).drop("rank").withColumn("logit", F.col("id") * 7919 % 1000)
    return ranking.pool_then_rerank(pool, "qid", "id", "score", "logit", 40, 16)


_NARROW = f"""with {BM25}, pool as (select item_id, doc_id, row_number() over (partition by item_id order by score desc, doc_id) as pos from scored),
terms_ as (select item_id, list_distinct({sql_tokens("text")}) as qt from benchmark),
items as (select p.item_id, p.doc_id, pos, len(list_filter(qt, lambda w: contains(lower(d.text), w)))::int as overlap
  from pool p join documents d using (doc_id) join terms_ using (item_id) where pos <= 16),
anyhow as (select *, max(overlap) over (partition by item_id) >= 1 as some_ from items),
ranked as (select *, row_number() over (partition by item_id order by overlap desc, pos) as n from anyhow where not some_ or overlap >= 1)"""


@query(f"{_NARROW} select item_id, doc_id, pos, overlap, row_number() over (partition by item_id order by pos) as place from ranked where n <= 8")
def narrow_lexical_topn(spark, sf_dir):
    pool = bm25.top(_scored(spark, sf_dir), "item_id", "doc_id", 16).select("item_id", "doc_id", F.col("rank").alias("pos"))
    b = table(spark, sf_dir, "benchmark").select("item_id", tx.content_terms(F.col("text")).alias("qt"))
    items = pool.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(b, "item_id").select("item_id", "doc_id", "pos", tx.substring_overlap(F.col("qt"), F.col("text")).alias("overlap"))
    return ranking.narrow(items, "item_id", "pos", "overlap", 8).select("item_id", "doc_id", "pos", "overlap", "place")


@query(f"""with {BM25}, ranked as (select item_id, doc_id, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored),
gold as (select distinct item_id, doc_id from ranked where rank % 3 = 1 and rank <= 12), k as (select unnest([8, 12, 16, 24, 32]) as k)
select k::int as k, count(g.doc_id) as hits, count(*) as kept, count(g.doc_id) / (select count(*) from gold) as recall, count(g.doc_id) / count(*) as precision
from ranked r join k on r.rank <= k left join gold g on g.item_id = r.item_id and g.doc_id = r.doc_id group by k""")
def topk_sweep(spark, sf_dir):
    ranked = store.written(bm25.top(_scored(spark, sf_dir), "item_id", "doc_id", 32).select("item_id", "doc_id", "rank"), "ranked")
    return ranking.sweep_k(ranked, ranked.filter("rank % 3 = 1 and rank <= 12").select("item_id", "doc_id"), "item_id", "doc_id", "rank", [8, 12, 16, 24, 32])


@query(f"""with asked as (select item_id, unnest(list_distinct({sql_tokens("text")})) as word from benchmark),
seen as (select word, count(*) as df from (select doc_id, unnest(list_distinct({sql_tokens("text")})) as word from documents) group by word)
select item_id, word, coalesce(df, 0) as df, coalesce(df, 0) between 1 and 50 as useful from asked left join seen using (word)""")
def keyword_df_reachability(spark, sf_dir):
    return turn_ops.keyword_reach(table(spark, sf_dir, "benchmark"), "item_id", "text", table(spark, sf_dir, "documents"), "doc_id", "text", 50)


@query(f"with {COSINE} select qid, id, score, rank from near where rank <= 10")
def index_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vector_index.build(e, store.shared_dir(spark, "index")).search(e.filter("vec_id % 100 = 0"), 10)


#: How often each of the letters a to z stands in a text: an embedding that SQL can express.
LETTERS = [chr(c) for c in range(97, 123)]


def letters(text):
    # without a lambda, so that a text is lowered once and not for each letter
    return F.array(*((F.length(text) - F.length(F.replace(F.lower(text), F.lit(c), F.lit("")))).cast("double") for c in LETTERS))


def sql_letters(col: str) -> str:
    return f"list_transform(range(97, 123), lambda c: (length({col}) - length(replace(lower({col}), chr(c::int), '')))::double)"


@query(f"""with w as (select distinct item_id, unnest({sql_tokens("text")}) as keyword from benchmark), k as (select distinct keyword, {sql_letters("keyword")} as v from w),
p as (select p_partkey as id, {sql_letters("p_name")} as v from part),
s as (select keyword, id, round(list_dot_product(k.v, p.v) / sqrt(list_dot_product(k.v, k.v) * list_dot_product(p.v, p.v)), 6) as score from k, p where list_dot_product(k.v, k.v) > 0 and list_dot_product(p.v, p.v) > 0),
r as (select *, row_number() over (partition by keyword order by score desc, id) as rank from s)
select item_id, keyword, id, score, rank from w join r using (keyword) where rank <= 5 and score >= 0.5""")
def keyword_vector_search(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), letters(F.col("p_name")).alias("embedding"))
    p = store.written(bm25.spread(p), "letters")
    asked = table(spark, sf_dir, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("keywords"))
    return vector_index.by_keyword(asked, vector_index.build(p, store.shared_dir(spark, "index")), "item_id", "keywords", letters, 5, 0.5)


@query(f"with {BM25} select item_id, doc_id, score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored) where rank <= 10")
def bm25_incremental(spark, sf_dir):
    """Documents come in by language, those of one language with other texts first and then anew; what was never to be indexed is removed."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    book = bm25_store.Stored(spark, store.shared_dir(spark, "live"), "doc_id")
    extra = d.filter("lang = 'en'").select((-F.col("doc_id") - 1).alias("doc_id"), F.reverse("text").alias("text"))
    book.put(d.filter("lang = 'en'").select("doc_id", F.concat(F.lit("stale words "), "text").alias("text")).union(extra), "text")
    book.put(d.filter("lang is distinct from 'en'"), "text")
    book.put(d.filter("lang = 'en'"), "text")
    book.remove(extra)
    return bm25.top(book.index().scores(table(spark, sf_dir, "benchmark"), "item_id", "text"), "item_id", "doc_id", 10)
