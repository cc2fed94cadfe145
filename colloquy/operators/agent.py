"""Refinement of evidence by the calls of a model, as joins over all questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import models, replies
from colloquy.functions import vector as vec
from colloquy.operators import turns as turn_ops
from colloquy.sources import store


def partition(rows: DataFrame, seed: str, final: str) -> DataFrame:
    """kept, added and dropped of two id arrays; null is empty."""
    none = F.array().cast("array<string>")
    s, f = F.coalesce(seed, none), F.coalesce(final, none)
    return rows.withColumn("kept", F.array_intersect(f, s)).withColumn("added", F.array_except(f, s)).withColumn("dropped", F.array_except(s, f))


def select(mode: str, seed, final, cap: int):
    """filter: final ids among the seeds; fetch_only: the seeds, then new ids; filter_fetch: as given. At most cap; the seeds where nothing is left."""
    chosen = {"filter": F.array_intersect(final, seed), "fetch_only": F.array_distinct(F.concat(seed, final)), "filter_fetch": F.array_distinct(final)}[mode]
    return F.slice(F.when(F.size(chosen) > 0, chosen).otherwise(seed), 1, cap)


def controlled(script: DataFrame, calls: int) -> DataFrame:
    """The calls of a script that take place: question, n, tool, text, ids, turns.

    script: question, step, command, and where it has one reasoning, from which a call is read if the command is none. A question's session ends with
    its FINAL, with three replies in a row that cannot be read, with a call that repeats the one before, and after `calls` replies, where the next one
    counts if it is a FINAL.
    """
    prose = F.col("reasoning") if "reasoning" in script.columns else F.lit(None).cast("string")
    by = Window.partitionBy("question").orderBy("step")
    read = script.select("question", "step", F.row_number().over(by).alias("n"), replies.read(F.col("command"), prose).alias("c")).filter(F.col("n") <= calls + 1)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    legible = F.col("c.tool").isNotNull()
    before = F.last(F.when(legible, F.col("c")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    told = read.withColumn("legible", F.count(F.when(legible, 1)).over(upto)).withColumn("repeat", F.coalesce(legible & F.col("c").eqNullSafe(before) & before.isNotNull(), F.lit(False)))
    bad = F.row_number().over(Window.partitionBy("question", "legible").orderBy("step")) - F.when(F.col("legible") > 0, 1).otherwise(0)
    ends = F.col("repeat") | (~legible & (bad == 3)) | F.coalesce(F.col("c.tool") == "FINAL", F.lit(False)) | (F.col("n") > calls)
    stop = F.min(F.when(F.col("ends"), F.col("n"))).over(Window.partitionBy("question"))
    lived = told.withColumn("ends", ends).withColumn("stop", stop).filter(legible & ~F.col("repeat"))
    return lived.filter((F.col("n") < F.coalesce("stop", F.lit(calls + 2))) | ((F.col("n") == F.col("stop")) & (F.col("c.tool") == "FINAL"))).select("question", "n", "c.*")


def grepped(asked: DataFrame, corpus: DataFrame, lines: int) -> DataFrame:
    """question, n, sid: the first `lines` turns that match the text of each call (question, n, text), dates of turns included where corpus has them.

    Quotes are no part of a pattern. A call without a hit that has two words of three characters or more finds the turns that hold them all, each from its start on.
    """
    hay = F.concat(F.when(F.col("date").isNotNull(), F.concat(F.lit("["), F.col("date"), F.lit("] "))).otherwise(""), F.coalesce("body", F.lit(""))) if "date" in corpus.columns else F.coalesce("body", F.lit(""))
    turns = corpus.withColumnRenamed("text", "body").withColumn("hay", hay).select("question", "sid", "pos", "hay")
    calls = asked.select("question", "n", F.trim(F.regexp_replace("text", "[\"“”]", " ")).alias("pattern"))
    hits = turns.join(calls, "question").filter(replies.found_by(F.col("hay"), F.col("pattern"))).select("question", "n", "sid", "pos")
    words = F.regexp_extract_all("pattern", F.lit("[A-Za-z0-9][A-Za-z0-9'-]{2,}"), F.lit(0))
    empty = calls.join(hits.select("question", "n").distinct(), ["question", "n"], "left_anti").select("question", "n", words.alias("words")).filter(F.size("words") >= 2)
    every = F.forall("words", lambda w: F.regexp_like(F.col("hay"), F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), w)))
    both = hits.union(turns.join(empty, "question").filter(every).select("question", "n", "sid", "pos"))
    first = Window.partitionBy("question", "n").orderBy("pos", "sid")
    return both.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= lines).select("question", "n", "sid")


def likened(asked: DataFrame, corpus: DataFrame, seeds: DataFrame, embed: Callable[[Column], Column], topn: int, least: float) -> DataFrame:
    """question, n, sid: of the 3 x topn turns most like the text of each call, from `least` on, the first topn that are no seeds. Only turns of questions that ask are embedded."""
    turns = corpus.join(asked.select("question").distinct(), "question", "left_semi").select("question", "sid", embed(F.coalesce("text", F.lit(""))).alias("v"))
    score = F.round(vec.dot(F.col("v"), F.col("q")), 6)
    like = turns.join(asked.select("question", "n", embed(F.col("text")).alias("q")), "question").select("question", "n", "sid", score.alias("score")).filter(F.col("score") >= least)
    best = Window.partitionBy("question", "n").orderBy(F.desc("score"), "sid")
    pool = like.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= 3 * topn)
    new = pool.join(seeds, ["question", "sid"], "left_anti").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= topn)
    return new.select("question", "n", "sid")


def neighbours(met: DataFrame, corpus: DataFrame, around: int) -> DataFrame:
    """question, n, sid: the turns about the first id of each call that resolves, as many to a side as it says, else `around`; a position is met by equality. met: question, n, turns, place, sid."""
    first = met.withColumn("p", F.min("place").over(Window.partitionBy("question", "n"))).filter("place = p")
    at = first.join(corpus.select("question", "sid", "pos"), ["question", "sid"])
    k = F.coalesce("turns", F.lit(around))
    band = at.select("question", "n", F.explode(F.sequence(F.col("pos") - k, F.col("pos") + k)).alias("pos")).distinct()
    return corpus.select("question", "sid", "pos").join(band, ["question", "pos"]).select("question", "n", "sid")


def refine(
    seeds: DataFrame, corpus: DataFrame, script: DataFrame, calls: int = 6, cap: int = 8, around: int = 2, mode: str = "filter_fetch", embed: Callable[[Column], Column] | None = None, topn: int = 3, least: float = 0.2, lines: int = 30
) -> DataFrame:
    """Evidence of each question after the calls of its script: question, sid, origin (seed, found or named).

    seeds: question, sid; corpus: question, sid, pos, text, and where it has one date; script: see controlled. GREP finds by pattern, VECTOR by likeness, READ takes
    neighbours, FINAL names the ids kept, which are resolved as READ's are. Ids are chosen by mode: filter takes those among the seeds, fetch_only the seeds and
    then new ids, filter_fetch all, in their order and at most cap; where none is left, the seeds stay. Calls do not depend on what earlier ones
    found, so each tool is one join over all questions; what a call can see is its question's turns. The calls and the ids that they name are written once.
    """
    turns = corpus.withColumn("pos", F.col("pos").cast("long"))
    start = seeds.select("question", "sid").distinct()
    said = store.written(controlled(script, calls), "calls")
    ids = said.select("question", "n", "tool", "turns", F.posexplode("ids").alias("place", "raw"))
    met = store.written(ids.join(turn_ops.resolved(ids.select("question", "raw"), turns.select("question", "sid"), ["question"]), ["question", "raw"]), "ids")
    of = lambda tool: said.filter(F.col("tool") == tool)
    hits = grepped(of("GREP"), turns, lines).union(likened(of("VECTOR"), turns, start, embed or models.embedder(), topn, least)).union(neighbours(met.filter("tool = 'READ'"), turns, around)).select("question", "sid").distinct()
    final = met.filter("tool = 'FINAL'").groupBy("question", "sid").agg(F.min("place").cast("long").alias("place"))
    ranked = start.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy("sid")).cast("long"))
    if mode == "filter":
        chosen = final.join(start, ["question", "sid"], "left_semi")
    elif mode == "fetch_only":
        asking = final.select("question").distinct()
        first = ranked.join(asking, "question", "left_semi").withColumn("place", F.col("place") - (1 << 40))
        chosen = first.unionByName(final).groupBy("question", "sid").agg(F.min("place").alias("place"))
    else:
        chosen = final
    chosen = chosen.select("question", "sid", "place").union(ranked.join(chosen.select("question").distinct(), "question", "left_anti").select("question", "sid", "place"))
    kept = chosen.withColumn("r", F.row_number().over(Window.partitionBy("question").orderBy("place", "sid"))).filter(F.col("r") <= cap)
    marked = kept.join(start.withColumn("s", F.lit(True)), ["question", "sid"], "left").join(hits.withColumn("f", F.lit(True)), ["question", "sid"], "left")
    return marked.select("question", "sid", F.when(F.col("s"), "seed").when(F.col("f"), "found").otherwise("named").alias("origin"))


def recovered(kept: DataFrame, seeds: DataFrame, verdicts: DataFrame, cap: int) -> DataFrame:
    """What refine kept, and discarded seeds with a KEEP among verdicts (question, sid, verdict), in the order of ids, as far as cap goes; no verdict drops."""
    size = kept.groupBy("question").agg(F.count("*").alias("_n"))
    keep = verdicts.filter(F.upper(F.trim("verdict")).startswith("KEEP")).select("question", "sid").distinct()
    again = seeds.select("question", "sid").distinct().join(kept.select("question", "sid"), ["question", "sid"], "left_anti").join(keep, ["question", "sid"], "left_semi")
    place = F.row_number().over(Window.partitionBy("question").orderBy("sid"))
    fits = again.withColumn("_r", place).join(size, "question", "left").filter(F.col("_r") + F.coalesce("_n", F.lit(0)) <= cap)
    return kept.select("question", "sid", "origin").union(fits.select("question", "sid", F.lit("recovered")))


def replayed(contexts: DataFrame, refined: DataFrame, texts: DataFrame, enabled: bool = True) -> DataFrame:
    """Saved contexts (question, context) with the lines of the ids that refinement kept, in its order; a question without any, or with the agent off, keeps its context."""
    if not enabled:
        return contexts.withColumn("refined", F.lit(False))
    lines = refined.join(texts.select("sid", "text", "pos"), "sid").groupBy("question").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sid", "text"))), lambda x: x["text"]), "\n").alias("_c"))
    return contexts.join(lines, "question", "left").select("question", F.coalesce("_c", "context").alias("context"), F.col("_c").isNotNull().alias("refined"))
