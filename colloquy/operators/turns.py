"""Dialogue turns: pairs, chunks, positions, windows and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as tx


def normal_turns(raw: DataFrame, session: str, index: str, role: str, content: str) -> DataFrame:
    """session_id, turn_index (0 if it is no number), role (trimmed, lower case), content."""
    return raw.select(
        F.col(session).cast("string").alias("session_id"),
        F.coalesce(F.expr(f"try_cast({index} as int)"), F.lit(0)).alias("turn_index"),
        F.lower(F.trim(F.coalesce(F.col(role), F.lit("")))).alias("role"),
        F.coalesce(F.col(content), F.lit("")).alias("content"),
    )


def turn_pairs(turns: DataFrame, session: str = "conv_id", index: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each assistant turn: its text and the user turn just before it, other roles not counted.

    Of two user turns in a row the first is dropped; a lone assistant turn has an empty user text; a last user turn is dropped.
    """
    w = Window.partitionBy(session).orderBy(index)
    seen = turns.filter(F.col(role).isin("user", "assistant"))
    prev = seen.withColumn("_r", F.lag(role).over(w)).withColumn("_t", F.lag(text).over(w))
    return prev.filter(F.col(role) == "assistant").select(session, F.col(index).alias("message_id"), F.when(F.col("_r") == "user", F.col("_t")).otherwise("").alias("user_text"), F.col(text).alias("assistant_text"))


def session_concat(turns: DataFrame, session: str = "conv_id", index: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """role: text lines of a session in order, with its largest index."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(index, role, text))), lambda t: F.concat(t[role], F.lit(": "), t[text])), "\n")
    return turns.groupBy(session).agg(F.max(index).alias("message_id"), F.count("*").alias("n_turns"), lines.alias("content"))


def positions(turns: DataFrame, session: str = "conv_id", index: str = "turn") -> DataFrame:
    return turns.withColumn("pos", F.row_number().over(Window.partitionBy(session).orderBy(index)) - 1)


def chunks(turns: DataFrame, n: int, session: str = "conv_id", index: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Runs of n turns of a session (all in one if n is not positive)."""
    chunk = F.floor(F.col("pos") / n) if n > 0 else F.lit(0).cast("long")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", role, text))), lambda t: F.concat(t[role], F.lit(": "), t[text])), " ")
    return positions(turns, session, index).groupBy(session, chunk.alias("chunk")).agg(F.count("*").alias("n_turns"), body.alias("body"))


def previous_user(turns: DataFrame, session: str = "conv_id", index: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """As-of join: for each assistant turn the last user text before it in the session, or null."""
    w = Window.partitionBy(session).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(role) == "user", F.col(text)), ignorenulls=True).over(w)
    return turns.withColumn("user_text", last).filter(F.col(role) == "assistant").select(session, index, "user_text", F.col(text).alias("assistant_text"))


def neighbour_window(turns: DataFrame, targets: DataFrame, k: int, session: str = "conv_id") -> DataFrame:
    """Distinct turns within k positions of a target (session, pos0): the band is a list of positions, so the join is on equality."""
    band = targets.select(session, F.explode(F.sequence(F.col("pos0") - k, F.col("pos0") + k)).alias("pos")).distinct()
    return turns.join(band, [session, "pos"])


def split_entries(pairs: DataFrame, session: str = "conv_id") -> DataFrame:
    """Two entries of each pair: sid:u with the user's text and sid:a with the assistant's, each falling back on the other."""
    u, a = F.col("user_text"), F.col("assistant_text")
    stem = F.concat_ws(":", session, "message_id")
    both = F.array(
        F.struct(F.concat(stem, F.lit(":u")).alias("sid"), F.lit("user").alias("role"), F.when(u == "", a).otherwise(u).alias("text")),
        F.struct(F.concat(stem, F.lit(":a")).alias("sid"), F.lit("assistant").alias("role"), F.when(a == "", u).otherwise(a).alias("text")),
    )
    return pairs.select(F.inline(both))


def turn_sid(session: Column, index: Column, role: Column) -> Column:
    """A user turn belongs to the answer after it."""
    return F.format_string("%s:%d:%s", session.cast("string"), F.when(role == "user", index + 1).otherwise(index), F.when(role == "user", "u").otherwise("a"))


def _direct(a: DataFrame, sids: DataFrame, by: list[str]) -> DataFrame:
    """by, raw, sid, step: exact, else the :u and :a entries of a pair, else the turns of a chunk (raw + t + number), all by equality."""
    exact = a.join(sids.withColumn("raw", F.col("sid")), [*by, "raw"]).select(*by, "raw", "sid", F.lit(1).alias("step"))
    pair = a.join(sids.filter(F.col("sid").rlike(":[ua]$")).select(*by, "sid", F.regexp_replace("sid", ":[ua]$", "").alias("raw")), [*by, "raw"]).select(*by, "raw", "sid", F.lit(2).alias("step"))
    chunk = a.join(sids.filter(F.col("sid").rlike("t[0-9]+$")).select(*by, "sid", F.regexp_replace("sid", "t[0-9]+$", "").alias("raw")), [*by, "raw"]).select(*by, "raw", "sid", F.lit(3).alias("step"))
    return exact.union(pair).union(chunk)


def _first_step(every: DataFrame, by: list[str]) -> DataFrame:
    return every.withColumn("_s", F.min("step").over(Window.partitionBy(*by, "raw"))).filter("step = _s").select(*by, "raw", "sid", "step")


def resolve_sids(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked (raw) to known (sid): exact, else the :u and :a entries of a pair, else the turns of a chunk (raw + t + number), else the one sid that ends in : + raw.

    Each step is an equality join on a derived key; the first step that finds something counts.
    """
    sids = known.select("sid").distinct()
    a = asked.select("raw").distinct()
    tails = sids.select("sid", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.split("sid", ":")) - 1)), lambda i: F.array_join(F.slice(F.split("sid", ":"), i + 1, F.lit(100)), ":"))).alias("raw")).filter("raw <> ''")
    one = tails.groupBy("raw").agg(F.min("sid").alias("sid"), F.count_distinct("sid").alias("n")).filter("n = 1")
    tail = a.join(one, "raw").select("raw", "sid", F.lit(4).alias("step"))
    return _first_step(_direct(a, sids, []).union(tail), [])


def resolved(asked: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """by, raw, sid, step of asked (by, raw) among known (by, sid): exact, pair or chunk; where none of these holds, the session of raw (what stands before its
    first colon) is read as the end of a session's name, and if that is one session only, raw is resolved once more under its whole name (steps 11 to 13).

    Names meet by equality: every session lists the ends of its name. Blanks around raw do not count; a raw that nothing resolves has no row.
    """
    sids = known.select(*by, "sid").distinct()
    a = asked.select(*by, "raw", F.trim("raw").alias("_raw")).distinct()
    tidy = a.select(*by, F.col("_raw").alias("raw")).distinct()
    direct = _first_step(_direct(tidy, sids, by), by)
    left = tidy.join(direct.select(*by, "raw").distinct(), [*by, "raw"], "left_anti")
    at = F.locate(":", F.col("raw"))
    split = left.filter((at > 1) & (at < F.length("raw"))).select(*by, "raw", F.substring_index("raw", ":", 1).alias("end"), F.expr("substr(raw, locate(':', raw) + 1)").alias("rest"))
    names = sids.select(*by, F.substring_index("sid", ":", 1).alias("session")).distinct()
    ends = names.filter(F.length("session") > 1).select(*by, "session", F.explode(F.transform(F.sequence(F.lit(2), F.length("session")), lambda i: F.substr(F.col("session"), i))).alias("end"))
    whole = split.join(ends, [*by, "end"]).groupBy(*by, "raw", "rest").agg(F.min("session").alias("session"), F.count("*").alias("n")).filter("n = 1")
    again = whole.select(*by, F.col("raw").alias("_first"), F.concat_ws(":", "session", "rest").alias("raw"))
    second = again.join(_first_step(_direct(again.select(*by, "raw").distinct(), sids, by), by), [*by, "raw"]).select(*by, F.col("_first").alias("raw"), "sid", (F.col("step") + 10).alias("step"))
    return a.join(direct.union(second).withColumnRenamed("raw", "_raw"), [*by, "_raw"]).select(*by, "raw", "sid", "step")


def grep(turns: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Case-insensitive search. A pattern that is no regular expression is taken literally; without any hit, turns that hold all its words of three letters or more at a left boundary."""
    import re

    expr = "(?i)" + (pattern if is_pattern(turns.sparkSession, pattern) else re.escape(pattern))
    hits = turns.filter(F.col(text).rlike(expr))
    words = [w for w in re.findall(r"\w+", pattern) if len(w) >= 3]
    none = F.expr("count(*) = 0")
    fallback = turns.filter(all_words(F.col(text), words)) if words else turns.filter(F.lit(False))
    empty = hits.limit(1).agg(none.alias("_none"))
    return hits.union(fallback.join(F.broadcast(empty.filter("_none")), F.lit(True), "left_semi"))


def is_pattern(spark, pattern: str) -> bool:
    """Whether the engine that runs patterns can read this one."""
    from pyspark.errors import PySparkException

    try:
        spark.range(1).select(F.lit("").rlike(pattern)).collect()
    except PySparkException:
        return False
    return True


def all_words(text: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & text.rlike(f"(?i)\\b{w}")
    return out


def keyword_reach(questions: DataFrame, key: str, question: str, docs: DataFrame, doc_key: str, text: str, most: int) -> DataFrame:
    """Per question and content word: in how many documents it occurs as a token, and whether that is few enough to be of use."""
    words = questions.select(key, F.explode(tx.content_terms(F.col(question))).alias("word"))
    seen = docs.select(doc_key, F.explode(tx.content_terms(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return words.join(seen, "word", "left").select(key, "word", F.coalesce("df", F.lit(0)).alias("df"), (F.coalesce("df", F.lit(0)).between(1, most)).alias("useful"))
