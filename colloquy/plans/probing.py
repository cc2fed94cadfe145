"""Queries over case probes, reach, pointwise scores and resumed judging."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import pointwise, probes, reach, resumable
from colloquy.plans.catalogue import query
from colloquy.sources import store
from colloquy.sources.tables import table

_STOPPED = "the and of to in is that it for on with as at by this be or an are was".split()
_STOP = ", ".join(f"'{w}'" for w in _STOPPED)


@query("""with l as (select o_custkey as c, l_orderkey as sid, l_partkey as id, l_quantity as q, l_discount as d, l_tax as t, l_returnflag as f, l_linestatus as s from lineitem join orders on l_orderkey = o_orderkey),
gold as (select distinct o_custkey as c, o_orderkey as sid from orders where o_orderpriority like '1%' or o_orderpriority like '2%'), summed as (select g.* from gold g where exists (select 1 from orders o where o.o_orderkey = g.sid and o.o_orderstatus <> 'P')),
target as (select distinct l.c, l.id from l join summed g on g.c = l.c and g.sid = l.sid where l.f = 'R'), pooled as (select t.* from target t where exists (select 1 from l where l.c = t.c and l.id = t.id and l.s = 'F')),
j as (select c, id, bool_and(d >= 0.02) as above, bool_and(q <= 42) as within_ from l group by c, id), cut as (select p.c, p.id, above, within_ from pooled p join j using (c, id) where not (above and within_)),
back as (select distinct c, id from l where t >= 0.05), ct as (select c, bool_or(not above) as low, bool_or(not within_) as late, count(b.id) as n from cut left join back b using (c, id) group by c),
ev as (select p.c from pooled p where not exists (select 1 from cut x where x.c = p.c and x.id = p.id) and exists (select 1 from l where l.c = p.c and l.id = p.id and l.t >= 0.03)),
s as (select c_custkey as c, case when c_acctbal < 0 then 'ingest' when c_custkey not in (select c from gold) then 'gold' when c_custkey not in (select c from summed) then 'summary' when c_custkey not in (select c from target) then 'extraction'
  when c_custkey not in (select c from pooled) then 'pool' when c_custkey in (select c from ct) then 'filter' when c_custkey not in (select c from ev) then 'evidence' else 'answer' end as step from customer)
select s.c as "case", step, case step when 'ingest' then 'ingest failed' when 'gold' then 'no gold marked' when 'summary' then 'no summary of the gold turns' when 'extraction' then 'nothing extracted from them' when 'pool' then 'no target entered the pool'
  when 'filter' then 'cut by ' || case when low and late then 'threshold and top-k' when low then 'threshold' else 'top-k' end || case when n > 0 then ' and recovered in part' else ' and not recovered' end
  when 'evidence' then 'no target reached the evidence' else 'all was there, the answer is wrong' end as cause from s left join ct using (c)""")
def case_probes(spark, sf_dir):
    """Customers are cases, their urgent orders gold turns, what they sent back targets, and figures of the lines the logs."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("sid"), "o_orderpriority", "o_orderstatus")
    said = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sid"), F.col("l_partkey").alias("id"), "l_returnflag", "l_linestatus", "l_discount", "l_quantity", "l_tax")
    lines = store.written(said.join(o.select("case", "sid"), "sid"), "lines")
    return probes.first_failing(
        c.select(F.col("c_custkey").alias("case")), c.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("case")), o.filter("o_orderpriority like '1%' or o_orderpriority like '2%'"), o.filter("o_orderstatus <> 'P'"),
        lines.filter("l_returnflag = 'R'").select("case", "sid", "id"), lines.filter("l_linestatus = 'F'").select("case", "id"),
        lines.select("case", "id", (F.col("l_discount") >= 0.02).alias("above"), (F.col("l_quantity") <= 42).alias("within")), lines.filter("l_tax >= 0.03").select("case", "id"), lines.filter("l_tax >= 0.05").select("case", "id"),
    )


def _sql_words(col: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({col}), '[a-z0-9][a-z0-9''-]*')), lambda w: (length(w) > 1 or regexp_matches(w, '^[0-9]$')) and w not in ({_STOP}))"


@query(f"""with t as (select conv_id, turn, role, lower(text) as text from conversations), q as (select a.conv_id, {_sql_words("a.text")} as qw, {_sql_words("b.text")} as aw from t a join t b on b.conv_id = a.conv_id and b.turn = a.turn + 2 where a.turn = 0),
w as (select conv_id, unnest(qw) as word from q), hit as (select w.conv_id, word, turn, role from w join t using (conv_id) where regexp_matches(text, '(^|[^a-z0-9])' || word || '($|[^a-z0-9''-])')),
df as (select conv_id, word, count(*) as df from hit group by all), g as (select conv_id, turn, text from t where role = 'assistant'),
f as (select conv_id, turn, count(*) as n, min(df) as least from hit join df using (conv_id, word) group by all),
flags as (select g.conv_id, g.turn, coalesce(n, 0) > 0 as a, coalesce(least <= 2, false) as u, coalesce(n, 0) > 1 as p,
  exists (select 1 from (select unnest(list_filter(q.aw, lambda w: not list_contains(q.qw, w))) as word) x where regexp_matches(g.text, '(^|[^a-z0-9])' || x.word || '($|[^a-z0-9''-])')) as s from g join q using (conv_id) left join f on f.conv_id = g.conv_id and f.turn = g.turn)
select conv_id as question, count(*) as n_gold, count(*) filter (a) as "any", count(*) filter (u) as useful, count(*) filter (p) as pair, count(*) filter (s) as answer, bool_and(a) as all_any, bool_and(u) as all_useful, bool_and(u or s) as all_useful_or_answer from flags group by conv_id""")
def pair_answer_reach(spark, sf_dir):
    """A conversation's first turn asks, its third answers, and what the assistant says is gold."""
    t = table(spark, sf_dir, "conversations")
    first, third = t.filter("turn = 0").select("conv_id", "text"), t.filter("turn = 2").select("conv_id", F.col("text").alias("answer"))
    asked = first.join(third, "conv_id").select(F.col("conv_id").alias("question"), F.col("conv_id").alias("haystack"), "text", "answer")
    return reach.summary(reach.reached(asked, t.select(F.col("conv_id").alias("haystack"), "turn", "text", (F.col("role") == "assistant").alias("gold")), 2, _STOPPED))


_ASK = {"entity": "Is this entity of use?", "relation": "Is this relation of use?"}


@query("""with e as (select *, case when event_type in ('view', 'click') then 'entity' else 'relation' end as kind from events),
s as (select user_id as question, kind, event_id as id, round(case when event_type = 'error' then case when contains(props, '1') then 1.0 else -1.0 end
  else case when value > 60 then -100 else -value / 100 end - case when value < 5 then -100 else -value / 50 end end, 6) as score from e where event_type <> 'signup')
select question, kind, id, score, row_number() over (partition by question, kind order by score desc, id) as rank from s""")
def pointwise_rerank(spark, sf_dir):
    """Recorded answers list tokens in several spellings, or lack yes or no; those to errors are texts, and those to signups are missing, which the threshold takes out."""
    e = table(spark, sf_dir, "events").filter("user_id is not null")
    kind = F.when(F.col("event_type").isin("view", "click"), "entity").otherwise("relation")
    pairs = e.select(F.col("user_id").alias("question"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("question_text"), kind.alias("kind"), F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("text"), "event_type", "value", "props")
    key = F.sha2(pointwise.prompt(_ASK, F.col("kind"), F.col("question_text"), F.col("text")), 256)
    token = lambda w, v: F.struct(w.alias("token"), v.alias("logprob"))
    yes = F.when(F.col("id") % 2 == 0, " Yes").otherwise("▁yes")
    listed = F.filter(F.array(F.when(F.col("value") <= 60, token(yes, -F.col("value") / 100)), F.when(F.col("value") >= 5, token(F.lit("NO "), -F.col("value") / 50)), token(F.lit("maybe"), F.lit(-3.0))), lambda t: t.isNotNull())
    answers = pairs.filter("event_type <> 'signup'").select(key.alias("key"), F.when(F.col("event_type") != "error", listed).alias("top"), F.when(F.contains("props", F.lit("1")), " Yes, it is").otherwise("hardly").alias("text"))
    return pointwise.reranked(pairs, answers, _ASK, threshold=-1000.0)


@query("""select event_id, case when event_type = 'error' then null when event_type = 'signup' then 1.0 when event_id % 10 < 4 then case when value > 50 then 1.0 else 0.0 end else 0.5 end as verdict from events""")
def resumed_judging(spark, sf_dir):
    """The first call stops after four of ten portions; a second one, whose judge says otherwise, does the rest only, and a third does nothing."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("question"), F.lit("said").alias("answer"), F.when(F.col("event_type") == "signup", 1.0).alias("verdict"), "value")
    path, portion = store.shared_dir(spark, "verdicts"), F.pmod("event_id", F.lit(10))
    strict = lambda part: part.withColumn("verdict", F.when(F.col("value") > 50, 1.0).otherwise(0.0))
    unsure = lambda part: part.withColumn("verdict", F.lit(0.5))
    resumable.judge(e, path, "event_id", strict, portion=portion, stop_after=4)
    resumable.judge(e, path, "event_id", unsure, portion=portion)
    return resumable.judge(e, path, "event_id", strict, portion=portion).select("event_id", "verdict")
