"""Rank, cut, quota and rerank operators over scored candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup_best(hits: DataFrame, query: str, key: str, richness: str, score: str) -> DataFrame:
    """Per query and key the hit with most provenance, then the best score; ranked by score, ties by key."""
    best = Window.partitionBy(query, key).orderBy(F.desc(richness), F.desc(score))
    kept = hits.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), key)))


def rerank_audit(scored: DataFrame, query: str, key: str, score: str, threshold: float, top_k: int) -> DataFrame:
    """Every candidate with its rank, whether it reaches the threshold, is selected among the first top_k of those that do, and why it was dropped."""
    order = Window.partitionBy(query).orderBy(F.desc(score), key)
    passing = F.sum(F.when(F.col(score) >= threshold, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    above = F.col(score) >= threshold
    selected = above & (passing <= top_k)
    return scored.select(
        query,
        key,
        score,
        F.row_number().over(order).alias("rank"),
        above.alias("above_threshold"),
        selected.alias("selected"),
        F.when(selected, "").when(above, "topk_cutoff").otherwise("below_threshold").alias("drop_reason"),
    )


def top_misses(audit: DataFrame, group: str, key: str, score: str, k: int = 3) -> DataFrame:
    """The k best candidates of each group that were not selected."""
    w = Window.partitionBy(group).orderBy(F.desc(score), "rank", key)
    return audit.filter("not selected").withColumn("miss", F.row_number().over(w)).filter(F.col("miss") <= k)


def quota_cut(scored: DataFrame, query: str, source: str, key: str, score: str, per_source: int, k: int) -> DataFrame:
    """The first per_source of each source are guaranteed, even beyond k; the best others fill up to k. Guaranteed rows come first. scored is read twice: a stored table spares computing it again."""
    # two ranks with a limit, which Spark cuts in each task: what is guaranteed, and the k best, of which only what is left over counts
    by_source = Window.partitionBy(query, source).orderBy(F.desc(score), key)
    sure = scored.withColumn("_n", F.row_number().over(by_source)).filter(F.col("_n") <= per_source).drop("_n").withColumn("guaranteed", F.lit(True))
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), key))).filter(F.col("_n") <= k).drop("_n")
    others = best.join(sure.select(query, key), [query, key], "left_anti").withColumn("guaranteed", F.lit(False))
    both = sure.unionByName(others.select(*sure.columns))
    total = F.sum(F.col("guaranteed").cast("int")).over(Window.partitionBy(query))
    within = F.row_number().over(Window.partitionBy(query, "guaranteed").orderBy(F.desc(score), key))
    kept = both.withColumn("_sure", total).withColumn("_n", within).filter(F.col("guaranteed") | (F.col("_n") <= k - F.col("_sure")))
    return kept.withColumn("position", F.when(F.col("guaranteed"), F.col("_n")).otherwise(F.col("_sure") + F.col("_n"))).drop("_sure", "_n")


def extra_slots(pool: DataFrame, direct: DataFrame, query: str, key: str, score: str, k: int, least: float) -> DataFrame:
    """The k best of the pool, plus direct hits of at least `least` that they do not hold, in one order."""
    order = Window.partitionBy(query).orderBy(F.desc(score), key)
    chosen = pool.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n").withColumn("slot", F.lit("pool"))
    extra = direct.filter(F.col(score) >= least).join(chosen, [query, key], "left_anti").withColumn("slot", F.lit("extra"))
    return chosen.unionByName(extra).withColumn("rank", F.row_number().over(order))


def pool_then_rerank(pool: DataFrame, query: str, key: str, cosine: str, rerank: str, cap: int, k: int) -> DataFrame:
    """The cap best by cosine are reranked and the k best kept; both scores stay, the order is the reranker's."""
    first = pool.withColumn("pool_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(cosine), key))).filter(F.col("pool_rank") <= cap)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(rerank), "pool_rank"))).filter(F.col("rank") <= k)


def narrow(items: DataFrame, query: str, position: str, overlap: str, k: int, least: int = 1) -> DataFrame:
    """The k items with most overlap of at least `least` (of all, if none has that), in their first order."""
    some = F.max(F.col(overlap)).over(Window.partitionBy(query)) >= least
    kept = items.withColumn("_some", some).filter(~F.col("_some") | (F.col(overlap) >= least)).drop("_some")
    ranked = kept.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(overlap), position))).filter(F.col("_n") <= k).drop("_n")
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(position)))


def containment_boost(items: DataFrame, query: str, contained: str, rank: str) -> DataFrame:
    """Contained items first, each part in its order."""
    return items.withColumn("boosted_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.when(F.col(contained), 0).otherwise(1), rank)))


def sweep_k(ranked: DataFrame, gold: DataFrame, query: str, key: str, rank: str, sizes: list[int]) -> DataFrame:
    """For each K: recall, precision and size of the first K items of every query against gold (query, key)."""
    ks = ranked.sparkSession.createDataFrame([(k,) for k in sizes], "k int")
    total = gold.count()
    marked = ranked.join(gold.select(query, key).distinct().withColumn("_gold", F.lit(1)), [query, key], "left")
    kept = marked.join(F.broadcast(ks), F.col(rank) <= F.col("k"))
    return kept.groupBy("k").agg(F.sum(F.coalesce("_gold", F.lit(0))).alias("hits"), F.count("*").alias("kept")).select("k", "hits", "kept", F.try_divide("hits", F.lit(total)).alias("recall"), F.try_divide("hits", "kept").alias("precision"))


def top_of(scored: DataFrame, query: str, key: str, score: str, k: int) -> DataFrame:
    """The k best of each query, ties by key."""
    return scored.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), key))).filter(F.col("_n") <= k).drop("_n")


def retrieve_then_rerank(pool: DataFrame, query: str, key: str, text: str, cosine: str, rerank: str, floor: float, cap: int, k: int) -> DataFrame:
    """The k first of each query by the reranker, among the cap best by cosine from the floor on whose text is not blank. Where any of these has no score of
    the reranker (it failed), the query falls back on cosine; by tells which. The cosine stays as the score that is shown."""
    best = Window.partitionBy(query).orderBy(F.desc(cosine), key)
    capped = pool.filter((F.col(cosine) >= floor) & (F.trim(F.coalesce(text, F.lit(""))) != "")).withColumn("pool_rank", F.row_number().over(best)).filter(F.col("pool_rank") <= cap)
    failed = F.max(F.col(rerank).isNull()).over(Window.partitionBy(query))
    judged = capped.withColumn("by", F.when(failed, "cosine").otherwise("reranker"))
    order = Window.partitionBy(query).orderBy(F.desc(F.when(F.col("by") == "reranker", F.col(rerank)).otherwise(F.col(cosine))), "pool_rank")
    return judged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def audit_by_kind(scored: DataFrame, query: str, kind: str, key: str, score: str, limits: dict[str, tuple[float, int]]) -> DataFrame:
    """rerank_audit of each kind (entities, relations) for itself, with its threshold and top-k; kinds without limits are left out."""
    out = None
    for name, (threshold, k) in limits.items():
        one = rerank_audit(scored.filter(F.col(kind) == name), query, key, score, threshold, k).withColumn("kind", F.lit(name))
        out = one if out is None else out.union(one)
    return out
