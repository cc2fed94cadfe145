"""Queries over parts of retrieval, ingestion and judging that others leave out: floors and fallbacks, means, parsers, retries, rebuilt evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import parsing as ps
from colloquy.functions import text as tx
from colloquy.operators import agent, evaluation, evidence, ingest, knn, ranking
from colloquy.plans.catalogue import query
from colloquy.plans.retrieval import COSINE, _near, letters, sql_letters, sql_tokens
from colloquy.sources import sinks, store
from colloquy.sources.tables import table


@query("""with r as (select event_type as run, user_id, count(*) as n from events where value > 55 group by all)
select run, user_id, n from r where user_id in (select user_id from r group by user_id having count(*) = (select count(distinct run) from r))""")
def runs_in_common(spark, sf_dir):
    r = table(spark, sf_dir, "events").filter("value > 55").groupBy(F.col("event_type").alias("run"), "user_id").agg(F.count("*").alias("n"))
    return evaluation.common_to_all(r, "run", "user_id").select("run", "user_id", "n")


@query("""with r as (select event_type as category, case when event_type <> 'signup' then value end as f1, length(props) as bleu from events),
a as (select category, count(*) as n, round(avg(f1), 6) as f1, round(avg(bleu), 6) as bleu from r group by category)
select * from a union all select 'ALL', count(*), round(avg(f1), 6), round(avg(bleu), 6) from r where category <> 'error'""")
def score_means(spark, sf_dir):
    """Scores come as text, as they are read from files; those of signups are no numbers."""
    e = table(spark, sf_dir, "events")
    rows = e.select("event_type", F.when(F.col("event_type") != "signup", F.col("value").cast("string")).otherwise("n/a").alias("f1"), F.length("props").cast("string").alias("bleu"))
    return evaluation.score_means(rows, "event_type", ["f1", "bleu"], "error")


_SAID = "'the ' || event_type || case when value > 60 then ' is correct' when value > 40 then ' is partial' when value > 20 then ' is Incorrect, not correct' else '' end || ' no. ' || event_id"


@query(f"""with s as (select event_id, value, {_SAID} as t from events), b as (select event_id, value, t, lower(t) as v from s)
select event_id, case when contains(v, 'yes') and not contains(v, 'no') then 1 when contains(v, 'no') and not contains(v, 'yes') then 0 when contains(v, '1') and not contains(v, '0') then 1 when contains(v, 'correct') and not contains(v, 'incorrect') then 1 else 0 end as yes,
case when value > 60 then 1.0 when value > 40 then 0.5 when value > 20 then 0.0 end as grade, case when value > 60 then 0.5 when value > 30 then 0.0 else 1.0 end as labelled from b""")
def judge_parsers(spark, sf_dir):
    v = F.col("value")
    how = F.when(v > 60, " is correct").when(v > 40, " is partial").when(v > 20, " is Incorrect, not correct").otherwise("")
    said = F.concat(F.lit("the "), "event_type", how, F.lit(" no. "), F.col("event_id").cast("string"))
    labelled = F.concat(F.lit('{"why": "wrong or not", "label": "'), F.when(v > 60, " Partial").when(v > 30, "WRONG").otherwise("correct"), F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", ps.says_yes(said).alias("yes"), ps.graded_label(said).alias("grade"), ps.graded_label(labelled).alias("labelled"))


@query(f"""with {COSINE}, p as (select n.qid, n.id, n.score, case when n.qid % 200 = 100 and n.id % 7 = 0 then null else (n.id * 7919) % 1000 end as logit, row_number() over (partition by n.qid order by n.score desc, n.id) as pool_rank
  from near n where rank <= 60 and n.score >= 0.15 and n.id % 5 <> 0),
c as (select *, bool_or(logit is null) over (partition by qid) as failed from p where pool_rank <= 20)
select qid, id, score, case when failed then 'cosine' else 'reranker' end as by, row_number() over (partition by qid order by case when failed then score else logit end desc, pool_rank) as rank from c qualify rank <= 8""")
def rerank_with_fallback(spark, sf_dir):
    """Every fifth text is blank, and the reranker has no score for some of every second query."""
    near = _near(spark, sf_dir, 60).drop("rank").withColumn("text", F.when(F.col("id") % 5 != 0, F.concat(F.lit("text "), F.col("id").cast("string"))).otherwise("  "))
    logit = F.when(~((F.col("qid") % 200 == 100) & (F.col("id") % 7 == 0)), (F.col("id") * 7919 % 1000).cast("double"))
    return ranking.retrieve_then_rerank(near.withColumn("logit", logit), "qid", "id", "text", "score", "logit", 0.15, 20, 8).select("qid", "id", "score", "by", "rank")


@query(f"""with {COSINE}, k as (select qid, id, score, case when id % 3 = 0 then 'relation' else 'entity' end as kind from near where rank <= 40),
r as (select *, case kind when 'entity' then 0.2 else 0.1 end as t, case kind when 'entity' then 4 else 2 end as k, row_number() over w as rank, sum((score >= case kind when 'entity' then 0.2 else 0.1 end)::int) over (partition by qid, kind order by score desc, id rows unbounded preceding) as passing from k window w as (partition by qid, kind order by score desc, id))
select qid, kind, id, score, rank, score >= t as above_threshold, score >= t and passing <= k as selected, case when score >= t and passing <= k then '' when score >= t then 'topk_cutoff' else 'below_threshold' end as drop_reason from r""")
def rerank_by_kind(spark, sf_dir):
    near = _near(spark, sf_dir, 40).drop("rank").withColumn("kind", F.when(F.col("id") % 3 == 0, "relation").otherwise("entity"))
    return ranking.audit_by_kind(near, "qid", "kind", "id", "score", {"entity": (0.2, 4), "relation": (0.1, 2)})


@query(f"""with p as (select p_partkey as id, p_name, {sql_tokens("p_name")} as t, {sql_letters("p_name")} as v from part), n as (select s_suppkey as id, 'old ' || p.p_name as name, {sql_tokens("'old ' || p.p_name")} as t, {sql_letters("'old ' || p.p_name")} as v from supplier join part p on p_partkey = s_suppkey),
lex as (select n.id, p.id as candidate, len(list_intersect(n.t, p.t)) as common, row_number() over (partition by n.id order by len(list_intersect(n.t, p.t)) desc, p.id) as r from n join p on len(list_intersect(n.t, p.t)) > 0),
d as (select id, candidate from (select n.id, p.id as candidate, row_number() over (partition by n.id order by round(list_dot_product(n.v, p.v) / sqrt(list_dot_product(n.v, n.v) * list_dot_product(p.v, p.v)), 6) desc, p.id) as r from n, p) where r <= 4)
select id, candidate, 'lexical' as channel from lex where r <= 3 union all select id, candidate, 'dense' from d where not exists (select 1 from lex l where l.r <= 3 and l.id = d.id and l.candidate = d.candidate)""")
def resolution_candidates(spark, sf_dir):
    """Known parts for new names: those that share most words, then the nearest by vector that are not among them."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate"), "p_name")
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).join(p.withColumnRenamed("candidate", "id"), "id").select("id", F.concat(F.lit("old "), "p_name").alias("name"))
    lexical = ingest.most_shared(new.select("id", tx.content_terms(F.col("name")).alias("w")), p.select("candidate", tx.content_terms(F.col("p_name")).alias("w")), "w", 3)
    dense = knn.top_k(new.select(F.col("id").alias("vec_id"), letters(F.col("name")).alias("embedding")), p.select(F.col("candidate").alias("vec_id"), letters(F.col("p_name")).alias("embedding")), 4, skip_self=False)
    return ingest.similar_candidates(new, lexical, dense.select(F.col("qid").alias("id"), F.col("id").alias("candidate")))


@query("""with e as (select *, row_number() over (partition by user_id order by event_id) as attempt from events where user_id is not null),
ok as (select user_id, attempt, event_type as name, props as description from e where attempt <= 3 and event_type not in ('error', 'view')), f as (select user_id, min(attempt) as attempt from ok group by user_id)
select user_id, attempt::int as attempt, name, 'Concept' as type, 'no. ' || length(description) as description from ok join f using (user_id, attempt)""")
def extraction_retries(spark, sf_dir):
    """A user's events are the attempts: an error has no answer, a view answers without an entity."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").filter("user_id is not null").withColumn("attempt", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    record = F.concat(F.lit('("entity"<|>'), "event_type", F.lit("<|>Concept<|>no. "), F.length("props").cast("string"), F.lit(")<|COMPLETE|>"))
    answers = e.select("user_id", "attempt", F.when(F.col("event_type") == "view", "I see nothing").when(F.col("event_type") != "error", record).alias("answer"))
    return ingest.extracted_in_tries(answers, "user_id", "attempt", "answer", 3).select("user_id", "attempt", "name", "type", "description")


@query("""with t as (select conv_id, (turn // 2)::bigint as m, turn, role, text from conversations where turn >= 2), c as (select conv_id, m, min(turn) as first, string_agg('[sid=' || conv_id || ':' || m || case turn % 2 when 0 then ':u]' else ':a]' end, '' order by turn % 2 desc) as tags,
  string_agg(length(text)::varchar, ' / ' order by turn % 2 desc) as body from t group by all), p as (select c.* from c where exists (select 1 from t where t.conv_id = c.conv_id and t.m = c.m and t.turn % 2 = 0))
select conv_id, string_agg('  • [t' || m || ']' || tags || ' ' || body, chr(10) order by m desc) as block, count(*) as n from p group by conv_id""")
def rebuilt_evidence(spark, sf_dir):
    """The user's halves are chosen, last first; each brings its answer with it."""
    t = table(spark, sf_dir, "conversations").filter("turn >= 2")
    m = F.floor(F.col("turn") / 2)
    sid = F.concat_ws(":", F.col("conv_id").cast("string"), m.cast("string"), F.when(F.col("turn") % 2 == 0, "u").otherwise("a"))
    turns = t.select("conv_id", "turn", sid.alias("sid"), F.concat(F.lit("t"), m.cast("string")).alias("at"), F.length("text").cast("string").alias("text"))
    chosen = turns.filter("turn % 2 = 0").select("conv_id", (-F.col("turn")).alias("place"), "sid")
    return evidence.rebuilt(chosen.union(chosen), turns.drop("conv_id", "turn"), "conv_id")


@query(f"""select d.doc_id, b.item_id, len(list_intersect({sql_tokens("d.text")}, {sql_tokens("b.text")}))::int as overlap from documents d join benchmark b on b.item_id = d.doc_id""")
def token_set_overlap(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t")), table(spark, sf_dir, "benchmark")
    return d.join(b, d.doc_id == b.item_id).select("doc_id", "item_id", tx.token_overlap(tx.content_terms(F.col("t")), tx.content_terms(F.col("text"))).alias("overlap"))


@query("""with t as (select conv_id, turn, conv_id || ':' || turn as sid, '[2024-01-0' || (turn + 1) || '] ' || text as hay from conversations), h as (select conv_id, 1 as n, sid, turn from t where contains(hay, '2024-01-03') or contains(hay, '2024-01-05')
  union all select conv_id, 2, sid, turn from t where regexp_matches(lower(hay), '(^|[^a-z0-9])the') and regexp_matches(lower(hay), '(^|[^a-z0-9])2024') and not exists (select 1 from t x where x.conv_id = t.conv_id and contains(lower(x.hay), 'the never 2024')))
select question, n, sid from (select conv_id as question, n, sid, row_number() over (partition by conv_id, n order by turn, sid) as r from h) where r <= 2""")
def grep_dates_and_words(spark, sf_dir):
    """Dates are part of what is searched; "the 2024" finds nothing as it stands, but turns that hold both words. Two lines a call are shown."""
    t = table(spark, sf_dir, "conversations")
    corpus = t.select(F.col("conv_id").alias("question"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sid"), F.col("turn").alias("pos"), "text", F.concat(F.lit("2024-01-0"), (F.col("turn") + 1).cast("string")).alias("date"))
    asked = t.select(F.col("conv_id").alias("question")).distinct().select("question", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.lit("2024-01-0[35]").alias("text")), F.struct(F.lit(2).alias("n"), F.lit('the "never 2024').alias("text")))).alias("c")).select("question", "c.n", F.when(F.col("c.n") == 2, "the 2024").otherwise(F.col("c.text")).alias("text"))
    return agent.grepped(asked, corpus, 2)


@query("""with d as (select user_id, event_type as type, strftime(ts, '%Y-%m-%d') as name from events where event_type in ('view', 'click')), f as (select user_id, event_type as type, strftime(ts, '%Y-%m-%d') as name from events where value > 30)
select distinct user_id, type, name from d where not exists (select 1 from f where f.user_id = d.user_id and f.type = d.type and f.name = d.name)""")
def missing_markers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("type"), F.date_format("ts", "yyyy-MM-dd").alias("name"), "value")
    return ingest.missing_markers(e.filter("type in ('view', 'click')"), e.filter("value > 30").withColumn("name", F.concat(F.lit(" "), "name")), "user_id")


@query("""select conv_id, count(*) as rows, sha256(string_agg(turn || ',' || role || ',' || length(text), chr(10) order by turn)) as sha256 from conversations group by conv_id""")
def question_files(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return sinks.write_questions(t, store.shared_dir(spark, "questions"), "conv_id", ["turn"])
