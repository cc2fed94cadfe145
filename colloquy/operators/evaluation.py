"""Aggregations that judge runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_binary(value: Column) -> Column:
    """0 or 1, anything else null: a missing verdict is not a wrong one."""
    v = value.try_cast("double")
    return F.when(v.isin(0.0, 1.0), v.cast("int"))


def accuracy_rollup(rows: DataFrame, category: str, verdict: str) -> DataFrame:
    """category (ALL for the whole), correct, total, accuracy in percent; unjudged rows count nowhere."""
    judged = rows.filter(F.col(verdict).isNotNull())
    return judged.rollup(category).agg(F.sum(verdict).alias("correct"), F.count("*").alias("total"), F.grouping(category).alias("_whole")).select(
        F.when(F.col("_whole") == 1, "ALL").otherwise(F.col(category)).alias("category"),
        F.col("correct").cast("long").alias("correct"),
        "total",
        F.round(100 * F.col("correct") / F.col("total"), 2).alias("accuracy"),
    )


def macro_average(rows: DataFrame, category: str, value: str, exclude: str) -> DataFrame:
    """Mean of category means, one category left out of it."""
    means = rows.groupBy(category).agg(F.avg(value).alias("mean"))
    return means.filter(F.col(category) != exclude).agg(F.round(F.avg("mean"), 6).alias("macro"), F.count("*").alias("categories"))


def majority_with_carry(votes: DataFrame, key: str, run: str, vote: str) -> DataFrame:
    """1 if the first run said so or at least half of all votes do; ties are 1."""
    return votes.groupBy(key).agg(F.sum(vote).alias("yes"), F.count(vote).alias("votes"), F.min_by(vote, run).alias("first")).select(
        key, F.col("yes").cast("long").alias("yes"), "votes", F.when((F.col("first") == 1) | (F.col("yes") * 2 >= F.col("votes")), 1).otherwise(0).alias("final")
    )


def mean_std(values: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and population deviation over two runs or more."""
    return values.groupBy(group).agg(F.count("*").alias("runs"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std")).filter("runs >= 2")


def flips(a: DataFrame, b: DataFrame, key: str, verdict: str, others: list[str]) -> DataFrame:
    """Keys whose verdict differs between two runs with equal key sets, and which of `others` changed (null equals null)."""
    x, y = a.alias("x"), b.alias("y")
    return x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}")).filter(~F.col(f"x.{verdict}").eqNullSafe(F.col(f"y.{verdict}"))).select(
        F.col(f"x.{key}").alias(key), F.col(f"x.{verdict}").alias("before"), F.col(f"y.{verdict}").alias("after"), *((~F.col(f"x.{o}").eqNullSafe(F.col(f"y.{o}"))).alias(f"{o}_changed") for o in others)
    )


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one run only, and keys that a run repeats."""
    n = a.groupBy(key).agg(F.count("*").alias("a")).join(b.groupBy(key).agg(F.count("*").alias("b")), key, "full")
    return n.select(key, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")).filter("a <> 1 or b <> 1")


def disagreement(runs: DataFrame, key: str, verdict: str) -> DataFrame:
    return runs.groupBy(key).agg(F.count_distinct(verdict).alias("verdicts"), F.count("*").alias("runs")).withColumn("status", F.when(F.col("verdicts") == 1, "unanimous").otherwise("disputed"))


def recall(gold: DataFrame, got: DataFrame, key: str, item: str) -> DataFrame:
    """Per key: gold items, those retrieved, and whether all were."""
    hit = gold.select(key, item).distinct().join(got.select(key, item).distinct().withColumn("_hit", F.lit(1)), [key, item], "left")
    return hit.groupBy(key).agg(F.count("*").alias("n_gold"), F.sum(F.coalesce("_hit", F.lit(0))).alias("n_hit")).withColumn("all_hit", F.col("n_gold") == F.col("n_hit"))


def nearest_quantiles(values: DataFrame, group: str, value: str, points: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """The sorted value at index min(n - 1, int(p * n)) for each p; by rank, so no list is gathered."""
    w = Window.partitionBy(group)
    ranked = values.filter(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    picks = [F.max(F.when(F.col("_i") == F.least(F.col("_n") - 1, F.floor(F.lit(p) * F.col("_n"))), F.col(value))).alias(f"q{int(p * 100)}") for p in points]
    return ranked.groupBy(group).agg(F.max("_n").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), *picks)


def histogram(values: DataFrame, value: str, low: float, high: float, bins: int = 14) -> DataFrame:
    """Counts of equal bins; values outside go to the outer ones."""
    step = (high - low) / bins
    b = F.least(F.greatest(F.floor((F.col(value) - low) / F.lit(step)), F.lit(0)), F.lit(bins - 1))
    return values.filter(F.col(value).isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def chunk_bounds(sessions: DataFrame, turns: str, chunks: str) -> DataFrame:
    """The chunk sizes that fit all sessions: at least ceil(T/C), at most floor((T-1)/(C-1)) where C > 1."""
    low = F.max(F.ceil(F.col(turns) / F.col(chunks)))
    high = F.min(F.when(F.col(chunks) > 1, F.floor((F.col(turns) - 1) / (F.col(chunks) - 1))))
    return sessions.agg(low.cast("long").alias("low"), high.cast("long").alias("high"))


def streak(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """How many of the last records of each key have the last one's value."""
    back = Window.partitionBy(key).orderBy(F.desc(order))
    last = F.first(value).over(back)
    broken = F.sum(F.when(F.col(value).eqNullSafe(F.col("_last")), 0).otherwise(1)).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("_last", last).withColumn("_b", broken).filter("_b = 0").groupBy(key).agg(F.count("*").alias("streak"), F.first("_last").alias("value"))


def bleu1(rows: DataFrame, keys: list[str], prediction: str, gold: str) -> DataFrame:
    """keys and BLEU-1 of token arrays, for long texts: token counts of both sides are joined instead of compared one by one."""
    p = rows.select(*keys, F.explode(prediction).alias("_w")).groupBy(*keys, "_w").agg(F.count("*").alias("_n"))
    g = rows.select(*keys, F.explode(gold).alias("_w")).groupBy(*keys, "_w").agg(F.count("*").alias("_m"))
    clipped = p.join(g, [*keys, "_w"]).groupBy(*keys).agg(F.sum(F.least("_n", "_m")).alias("_c"))
    n, m = F.size(prediction), F.size(gold)
    score = F.when(F.col("_c").isNull(), 0.0).otherwise(F.when(n > m, 1.0).otherwise(F.exp(1 - m / n)) * F.col("_c") / n)
    return rows.select(*keys, prediction, gold).join(clipped, keys, "left").select(*keys, score.alias("bleu"))


def reachability(rows: DataFrame, category: str, flags: list[str]) -> DataFrame:
    """Per category and for all (TOTAL): questions, how many have each flag, and their share."""
    sums = [F.sum(F.col(f).cast("int")).alias(f) for f in flags]
    got = rows.rollup(category).agg(F.count("*").alias("n"), *sums, F.grouping(category).alias("_all"))
    return got.select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(category)).alias(category), "n", *flags, *(F.round(F.try_divide(f, "n"), 6).alias(f"{f}_share") for f in flags))


def flips_within(rows: DataFrame, key: str, before: str, after: str, a: int, b: int, last: Column) -> DataFrame:
    """Rows judged a by one column and b by another, those for which `last` holds at the end; place is the order."""
    found = rows.filter((F.col(before) == a) & (F.col(after) == b)).withColumn("_late", last.cast("int"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("_late").orderBy(key))).withColumnRenamed("_late", "late")


def merged_runs(parts: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of per-sample files, each of a key once; a key that the merged file holds comes from there. Of several rows of a key the one that is smallest by its columns counts, whatever order they come in."""
    columns = merged.columns
    rest = [c for c in columns if c not in keys]
    both = merged.unionByName(parts.select(*columns).join(merged.select(*keys), keys, "left_anti"))
    return both.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*(F.col(c) if c in keys else F.col(f"_row.{c}") for c in columns))


def first_and_last(records: DataFrame, key: str, order: str, first: list[str], last: list[str]) -> DataFrame:
    """Per key the columns `first` of its first record and `last` of its last one, as replays read them."""
    return records.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in first), *(F.max_by(c, order).alias(c) for c in last))


def event_groups(log: DataFrame, request: str, event: str, order: str) -> DataFrame:
    """Per request and type of event: how many, the first and the last by order."""
    return log.groupBy(request, event).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def contains_any(text: Column, parts: list[str]) -> Column:
    """Whether a text holds any of the parts, in any case; without parts every text does."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*(F.lit(p.lower()) for p in parts)), lambda p: F.contains(low, p)) if parts else F.lit(True)


def gold_answer(answer: Column, adversarial: Column) -> Column:
    """The answer, else the adversarial one, else empty; a blank one counts as missing."""
    return F.coalesce(F.when(F.trim(answer) != "", answer), F.when(F.trim(adversarial) != "", adversarial), F.lit(""))


def completion(planned: DataFrame, done: DataFrame, group: str, key: str) -> DataFrame:
    """Per group of planned keys how many there are and how many are done."""
    marked = planned.join(done.select(key).distinct().withColumn("_done", F.lit(1)), key, "left")
    return marked.groupBy(group).agg(F.count("*").alias("total"), F.count("_done").alias("done"))


def diagnosis_bundle(evaluated: DataFrame, judged: DataFrame, key: str, verdict: str, flags: Column, cause: Column) -> DataFrame:
    """Evaluated questions with their verdict: flags for all, the cause for wrong ones alone."""
    both = evaluated.join(judged.select(key, verdict), key, "left")
    return both.select(key, verdict, flags.alias("flags"), F.when(F.col(verdict) == 0, cause).alias("cause"))


def text_variants(retrieved: DataFrame, texts: dict[str, DataFrame], question: str, key: str, order: str) -> DataFrame:
    """variant, question, context: a fixed retrieved set with its texts swapped; texts: per variant key and text; a key without a text there is left out."""
    every = None
    for name, table in texts.items():
        got = retrieved.join(table.select(key, "text"), key).groupBy(question).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n").alias("context"))
        got = got.select(F.lit(name).alias("variant"), question, "context")
        every = got if every is None else every.union(got)
    return every


def raw_text(raw: Column, text: Column, looked_up: Column, summary: Column) -> Column:
    """The first of these that is not blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in (raw, text, looked_up, summary)))


def scored_items(rows: DataFrame, file: str, order: str, usual: str, abstention: str, answers: list[str]) -> DataFrame:
    """The first row of each file with its verdict - of the abstention column for files named ..._abs - and its answer, the first column that is not blank; rows whose verdict is no 0 or 1 go."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(file).orderBy(order))).filter("_n = 1")
    verdict = as_binary(F.when(F.col(file).endswith("_abs"), F.col(abstention)).otherwise(F.col(usual)))
    answer = F.coalesce(*(F.when(F.trim(F.col(a)) != "", F.col(a)) for a in answers))
    return first.select(file, verdict.alias("verdict"), answer.alias("answer")).filter("verdict is not null")


def common_to_all(runs: DataFrame, run: str, key: str) -> DataFrame:
    """The rows of keys that every run has, in any number of runs: one count of runs a key, no chain of joins."""
    n = runs.agg(F.count_distinct(run).alias("_all"))
    whole = runs.groupBy(key).agg(F.count_distinct(run).alias("_n")).join(F.broadcast(n), F.col("_n") == F.col("_all"), "left_semi")
    return runs.join(whole.select(key), key, "left_semi")


def score_means(rows: DataFrame, category: str, scores: list[str], adversarial: str) -> DataFrame:
    """Means of the scores by category, and overall (ALL) without the adversarial category, which has a mean of its own all the same. What is no number counts nowhere, and a mean of nothing is null, not 0."""
    every = rows.select(F.col(category).alias("category"), *(F.col(c).try_cast("double").alias(c) for c in scores))
    by = every.groupBy("category").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in scores))
    usual = ~F.col("category").eqNullSafe(F.lit(adversarial))
    return by.union(every.filter(usual).agg(F.lit("ALL"), F.count("*"), *(F.round(F.avg(c), 6) for c in scores)))
