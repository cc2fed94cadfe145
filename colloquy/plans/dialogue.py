"""Queries over conversations: pairs, chunks, windows, search, identifiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import evaluation
from colloquy.operators import turns as ops
from colloquy.plans.catalogue import query
from colloquy.sources.tables import table

PAIRS = """pairs as (select conv_id, turn as message_id, case when r = 'user' then t else '' end as user_text, text as assistant_text
  from (select *, lag(role) over w as r, lag(text) over w as t from conversations where role in ('user', 'assistant') window w as (partition by conv_id order by turn)) where role = 'assistant')"""
POS = "pos as (select *, row_number() over (partition by conv_id order by turn) - 1 as pos from conversations)"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query("select conv_id::varchar as session_id, turn::int as turn_index, lower(trim(role)) as role, text as content from conversations")
def session_normalize(spark, sf_dir):
    return ops.normal_turns(_turns(spark, sf_dir), "conv_id", "turn", "role", "text")


@query(f"with {PAIRS} select * from pairs")
def turn_pairs(spark, sf_dir):
    return ops.turn_pairs(_turns(spark, sf_dir))


@query("select conv_id, max(turn) as message_id, count(*) as n_turns, string_agg(role || ': ' || text, chr(10) order by turn) as content from conversations group by conv_id")
def session_concat(spark, sf_dir):
    return ops.session_concat(_turns(spark, sf_dir))


@query(f"with {POS} select conv_id, turn, pos from pos")
def turn_positions(spark, sf_dir):
    return ops.positions(_turns(spark, sf_dir)).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"))


@query(f"with {POS} select conv_id, pos // 3 as chunk, count(*) as n_turns, string_agg(role || ': ' || text, ' ' order by pos) as body from pos group by conv_id, pos // 3")
def turn_chunks(spark, sf_dir):
    return ops.chunks(_turns(spark, sf_dir), 3)


@query("""select conv_id, turn, user_text, text as assistant_text from (select *, last_value(case when role = 'user' then text end ignore nulls)
  over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as user_text from conversations) where role = 'assistant'""")
def previous_user_asof(spark, sf_dir):
    return ops.previous_user(_turns(spark, sf_dir))


@query(f"with {POS}, target as (select conv_id, pos as p0 from pos where contains(lower(text), 'that')) select distinct p.conv_id, p.turn, p.pos from pos p join target t on p.conv_id = t.conv_id and abs(p.pos - t.p0) <= 1")
def turn_window_k(spark, sf_dir):
    pos = ops.positions(_turns(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))
    targets = pos.filter(F.contains(F.lower("text"), F.lit("that"))).select("conv_id", F.col("pos").alias("pos0"))
    return ops.neighbour_window(pos, targets, 1).select("conv_id", "turn", "pos")


@query(f"""with {PAIRS} select conv_id || ':' || message_id || ':u' as sid, 'user' as role, case when user_text = '' then assistant_text else user_text end as text from pairs
union all select conv_id || ':' || message_id || ':a', 'assistant', case when assistant_text = '' then user_text else assistant_text end from pairs""")
def split_entries_ua(spark, sf_dir):
    return ops.split_entries(ops.turn_pairs(_turns(spark, sf_dir)))


@query("select conv_id, turn, conv_id || ':' || case when role = 'user' then turn + 1 else turn end || ':' || case when role = 'user' then 'u' else 'a' end as sid from conversations where role <> 'system'")
def sid_from_turn(spark, sf_dir):
    t = _turns(spark, sf_dir).filter("role <> 'system'")
    return t.select("conv_id", "turn", ops.turn_sid(F.col("conv_id"), F.col("turn"), F.col("role")).alias("sid"))


_SIDS = """known as (select distinct 'c' || conv_id || ':' || case when role = 'user' then turn + 1 else turn end || ':' || case when role = 'user' then 'u' else 'a' end as sid from conversations where role <> 'system'
  union select 'k' || conv_id || ':' || (turn // 3) || 't' || turn from conversations where role <> 'system')"""


@query(f"""with {_SIDS}, asked as (select distinct case when (conv_id + turn) % 4 = 0 then 'c' || conv_id || ':' || turn || ':a' when (conv_id + turn) % 4 = 1 then 'c' || conv_id || ':' || turn
    when (conv_id + turn) % 4 = 2 then 'k' || conv_id || ':' || (turn // 3) else turn || ':a' end as raw from conversations where role <> 'system'),
tails as (select sid, array_to_string(string_split(sid, ':')[i + 1:], ':') as raw from (select sid, unnest(range(1, len(string_split(sid, ':')))) as i from known)),
hit as (select raw, sid, 1 as step from asked join known on sid = raw
  union all select raw, sid, 2 from asked join (select sid, regexp_replace(sid, ':[ua]$', '') as raw from known where regexp_matches(sid, ':[ua]$')) using (raw)
  union all select raw, sid, 3 from asked join (select sid, regexp_replace(sid, 't[0-9]+$', '') as raw from known where regexp_matches(sid, 't[0-9]+$')) using (raw)
  union all select raw, any_value(sid), 4 from asked join tails using (raw) group by raw having count(*) = 1)
select raw, sid, step from (select *, min(step) over (partition by raw) as best from hit) where step = best""")
def sid_resolve(spark, sf_dir):
    t = _turns(spark, sf_dir).filter("role <> 'system'")
    c, n, chunk = F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.floor(F.col("turn") / 3).cast("string")
    own = t.select(F.concat(F.lit("c"), ops.turn_sid(F.col("conv_id"), F.col("turn"), F.col("role"))).alias("sid"))
    known = own.union(t.select(F.concat(F.lit("k"), c, F.lit(":"), chunk, F.lit("t"), n)))
    kind = (F.col("conv_id") + F.col("turn")) % 4
    raw = F.when(kind == 0, F.concat(F.lit("c"), c, F.lit(":"), n, F.lit(":a"))).when(kind == 1, F.concat(F.lit("c"), c, F.lit(":"), n)).when(kind == 2, F.concat(F.lit("k"), c, F.lit(":"), chunk)).otherwise(F.concat(n, F.lit(":a")))
    return ops.resolve_sids(t.select(raw.alias("raw")), known)


@query("select conv_id, turn, role from conversations where regexp_matches(text, '(?i)\\bth(at|is)\\b.*\\bof\\b', 's')")
def grep_regex(spark, sf_dir):
    return ops.grep(_turns(spark, sf_dir), "(?s)\\bth(at|is)\\b.*\\bof\\b").select("conv_id", "turn", "role")


@query("select conv_id, turn from conversations where regexp_matches(text, '(?i)\\bthe') and regexp_matches(text, '(?i)\\bwas') and regexp_matches(text, '(?i)\\bwith')")
def grep_all_words(spark, sf_dir):
    return ops.grep(_turns(spark, sf_dir), "the (was] with").select("conv_id", "turn")


@query("""with m as (select conv_id, turn, text, regexp_extract(text, '[a-z]+tion[a-z]*') as found from conversations where regexp_matches(text, '[a-z]+tion[a-z]*')),
p as (select *, instr(text, found) as pl from m)
select conv_id, turn, (case when greatest(1, pl - 90) > 1 then '...' else '' end) || substring(text, greatest(1, pl - 90), least(length(text), pl + length(found) - 1 + 90) - greatest(1, pl - 90) + 1)
  || (case when least(length(text), pl + length(found) - 1 + 90) < length(text) then '...' else '' end) as snippet from p""")
def grep_snippet(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", tx.snippet(F.col("text"), "[a-z]+tion[a-z]*").alias("snippet")).filter("snippet is not null")


@query("""select conv_id, turn, substring(case when role = 'user' then 'User : ' else 'Assistant : ' end || trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 120) as entry from conversations where role <> 'system'""")
def display_entries(spark, sf_dir):
    return _turns(spark, sf_dir).filter("role <> 'system'").select("conv_id", "turn", tx.display_turn(F.col("role"), F.col("text"), 120).alias("entry"))


@query(f"""with {PAIRS}, s as (select {{tok}} as p, {{tok2}} as g, conv_id, message_id from pairs where user_text <> ''),
c as (select *, len(list_intersect(list_distinct(p), list_distinct(g))) as common from s)
select conv_id, message_id, round(case when common = 0 then 0 else 2.0 * (common / len(list_distinct(p))) * (common / len(list_distinct(g))) / (common / len(list_distinct(p)) + common / len(list_distinct(g))) end, 6) as f1 from c""".replace("{tok}", "list_filter(string_split_regex(trim(regexp_replace(translate(lower(assistant_text), '.,!?', '    '), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')").replace("{tok2}", "list_filter(string_split_regex(trim(regexp_replace(translate(lower(user_text), '.,!?', '    '), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')"))
def token_f1(spark, sf_dir):
    p = ops.turn_pairs(_turns(spark, sf_dir)).filter("user_text <> ''")
    return p.select("conv_id", "message_id", F.round(tx.token_f1(tx.simple_tokens(F.col("assistant_text")), tx.simple_tokens(F.col("user_text"))), 6).alias("f1"))


_TOK = "list_filter(string_split_regex(trim(regexp_replace(translate(lower({}), '.,!?', '    '), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')"


@query(f"""with {PAIRS}, s as (select conv_id, message_id, {_TOK.format('assistant_text')} as p, {_TOK.format('user_text')} as g from pairs where user_text <> ''),
a as (select conv_id, message_id, w, count(*) as n from (select conv_id, message_id, unnest(p) as w from s) group by all),
b as (select conv_id, message_id, w, count(*) as m from (select conv_id, message_id, unnest(g) as w from s) group by all),
c as (select conv_id, message_id, sum(least(n, m)) as clipped from a join b using (conv_id, message_id, w) group by all)
select conv_id, message_id, round(case when coalesce(clipped, 0) = 0 then 0.0 else case when len(p) > len(g) then 1.0 else exp(1 - len(g) / len(p)) end * clipped / len(p) end, 6) as bleu
from s left join c using (conv_id, message_id)""")
def bleu1(spark, sf_dir):
    p = ops.turn_pairs(_turns(spark, sf_dir)).filter("user_text <> ''")
    rows = p.select("conv_id", "message_id", tx.simple_tokens(F.col("assistant_text")).alias("p"), tx.simple_tokens(F.col("user_text")).alias("g"))
    return evaluation.bleu1(rows, ["conv_id", "message_id"], "p", "g").withColumn("bleu", F.round("bleu", 6))


@query("""with s as (select conv_id, count(*) as turns, (count(*) + 2) // 3 as chunks from conversations group by conv_id)
select max(ceil(turns / chunks))::bigint as low, min(case when chunks > 1 then (turns - 1) // (chunks - 1) end)::bigint as high from s""")
def chunk_size_bounds(spark, sf_dir):
    s = _turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("turns")).withColumn("chunks", F.floor((F.col("turns") + 2) / 3))
    return evaluation.chunk_bounds(s, "turns", "chunks")


@query("select conv_id, count(*) as turns, count(*) filter (where role = 'user') as n_user, count(*) filter (where role = 'assistant') as n_assistant, count(*) filter (where role = 'system') as n_system, sum(length(text))::bigint as chars from conversations group by conv_id")
def dataset_stats_pivot(spark, sf_dir):
    t = _turns(spark, sf_dir)
    wide = t.groupBy("conv_id").pivot("role", ["user", "assistant", "system"]).agg(F.count("turn"))
    total = t.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    return total.join(wide, "conv_id").select("conv_id", "turns", *(F.coalesce(r, F.lit(0)).cast("long").alias(f"n_{r}") for r in ("user", "assistant", "system")), "chars")


@query(f"with {POS}, gold as (select conv_id, turn from conversations where role = 'assistant' and turn % 2 = 1) select p.conv_id, string_agg(p.role || ': ' || p.text, chr(10) order by p.turn) as context from pos p where exists (select 1 from gold g join pos q using (conv_id, turn) where q.conv_id = p.conv_id and abs(q.pos - p.pos) <= 1) group by p.conv_id")
def oracle_context(spark, sf_dir):
    pos = ops.positions(_turns(spark, sf_dir))
    targets = pos.filter("role = 'assistant' and turn % 2 = 1").select("conv_id", F.col("pos").alias("pos0"))
    return ops.session_concat(ops.neighbour_window(pos, targets, 1)).select("conv_id", F.col("content").alias("context"))


@query("select conv_id, turn, first_turn from (select conv_id, turn, first_value(turn) over (partition by conv_id, text order by turn) as first_turn from conversations) where turn = first_turn")
def first_occurrence(spark, sf_dir):
    w = Window.partitionBy("conv_id", "text").orderBy("turn")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.first("turn").over(w).alias("first_turn")).filter("turn = first_turn")
