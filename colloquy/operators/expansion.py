"""From seeds to a question's subgraph: keyword searches, weighted frontiers, merges, fallbacks and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators import graph


def keyword_union(high: Column, low: Column, mode: str) -> Column:
    """Keywords of a mode: high, low, or both without repeats, high ones first; null is empty."""
    none = F.array().cast("array<string>")
    h, w = F.coalesce(high, none), F.coalesce(low, none)
    return {"high": h, "low": w, "both": F.array_distinct(F.concat(h, w))}[mode]


def per_keyword(hits: DataFrame, question: str, keyword: str, key: str, score: str, k: int, least: float) -> DataFrame:
    """The k best hits of each keyword of a question at or above least, with their rank; a key found by several keywords stays with each."""
    w = Window.partitionBy(question, keyword).orderBy(F.desc(score), key)
    return hits.filter(F.col(score) >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def weighted_frontier(seeds: DataFrame, edges: DataFrame, scores: DataFrame, hops: int, cut: float) -> DataFrame:
    """id, hop, of vertices reached level by level over edges whose weight (score - cut) / (1 - cut) is positive.

    seeds: id; edges: src, rel, dst, taken both ways; scores: rel, score. Weak edges go before a level is
    expanded, so what lies behind them is not reached; the visited set is global and a vertex keeps its first hop.
    """
    kept = graph.edge_weights(edges, scores, cut)
    return graph.frontier(seeds, kept.select("src", "rel", "dst"), hops)


def merged_ids(by_node: DataFrame, by_edge: DataFrame, key: str, intersect: bool = False) -> DataFrame:
    """Ids of both branches: their union, or their intersection unless the edge branch is empty."""
    a, b = by_node.select(key).distinct(), by_edge.select(key).distinct()
    if not intersect or b.isEmpty():
        return a.union(b).distinct()
    return a.intersect(b)


def ordered_union(first: DataFrame, then: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """Keys of `first` in their order, then those of `then` that are new, in theirs; each once, with its place."""
    both = first.select(group, key, F.lit(0).alias("_p"), F.col(order).alias("_o")).union(then.select(group, key, F.lit(1), F.col(order)))
    once = both.groupBy(group, key).agg(F.min(F.struct("_p", "_o")).alias("_at"))
    return once.select(group, key, F.row_number().over(Window.partitionBy(group).orderBy("_at", key)).alias("place"))


def with_cache(wanted: DataFrame, found: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows of `found` for the wanted keys; those that it lacks from the cache, with empty neighbours. Both: key, name, neighbours (array)."""
    hit = found.join(wanted.select(key).distinct(), key, "left_semi").withColumn("source", F.lit("graph"))
    missing = wanted.select(key).distinct().join(found.select(key), key, "left_anti")
    filled = missing.join(cache.select(key, "name"), key).withColumn("neighbours", F.array().cast("array<string>")).withColumn("source", F.lit("cache"))
    return hit.select(key, "name", "neighbours", "source").union(filled.select(key, "name", "neighbours", "source"))


def with_metadata(ids: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Ids in any number with the name and kind of their metadata; null where there is none. Of several records of a key the first by kind and name counts."""
    first = metadata.groupBy(key).agg(F.min(F.struct("kind", "name")).alias("_m"))
    return ids.join(first, key, "left").select(*ids.columns, F.col("_m.name").alias("name"), F.col("_m.kind").alias("kind"))


def relation_label(name_source: Column, meta_source: Column, id_source: Column, name_target: Column, meta_target: Column, id_target: Column, description: Column) -> Column:
    """source -> target | description: each end by its name, else that of its metadata, else its id, else a question mark; a blank description is left out."""
    def end(*chain: Column) -> Column:
        return F.coalesce(*(F.when(F.trim(c) != "", c) for c in chain), F.lit("?"))

    said = F.when(F.trim(F.coalesce(description, F.lit(""))) != "", F.concat(F.lit(" | "), description)).otherwise("")
    return F.concat(end(name_source, meta_source, id_source), F.lit(" -> "), end(name_target, meta_target, id_target), said)


def search_beyond(hits: DataFrame, seeds: DataFrame, question: str, key: str, score: str, topn: int, least: float) -> DataFrame:
    """A tool's vector search: of the 3 x topn best hits of a question at or above least, those that are no seeds, topn at most."""
    w = Window.partitionBy(question).orderBy(F.desc(score), key)
    pool = hits.filter(F.col(score) >= least).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 3 * topn).drop("_n")
    new = pool.join(seeds.select(question, key), [question, key], "left_anti")
    return new.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= topn)


def names_of(ids: DataFrame, names: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """Per group the distinct names of its ids in the order of first use; ids without a name by themselves."""
    named = ids.join(names.select(key, "name"), key, "left").withColumn("name", F.coalesce("name", F.col(key).cast("string")))
    first = named.groupBy(group, "name").agg(F.min(order).alias("_o"))
    said = F.transform(F.sort_array(F.collect_list(F.struct("_o", "name"))), lambda x: x["name"])
    return first.groupBy(group).agg(said.alias("names"))


def by_id(candidates: DataFrame, group: str, key: str) -> DataFrame:
    """Candidates as they are, each with its place by id, so that later steps see one order."""
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(key)))


def capped(evidence: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first `most` pieces of evidence of each group."""
    return evidence.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("place") <= most)
