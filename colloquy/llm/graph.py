"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import cluster

#: Edges from which on a node is a hub, and most hubs that are sent to tasks in a round.
HUB, MOST_HUBS = 1000, 50_000


def with_least(edges: DataFrame, both: DataFrame) -> DataFrame:
    """u, v, m: edges with the smallest of u and its neighbours in `both`, which is combined before the shuffle.

    Hubs, up to MOST_HUBS of them, are sent to tasks with theirs, so that their edges stay where they
    are; beyond that, and for all other nodes, edges and minima are joined.
    """
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hubs = low.filter(F.col("n") > HUB).select("u", "m").limit(MOST_HUBS + 1).collect()
    low = low.select("u", "m")
    if not hubs or len(hubs) > MOST_HUBS:
        return edges.join(low, "u").select("u", "v", "m")
    few = edges.sparkSession.createDataFrame(hubs, low.schema).withColumnRenamed("m", "least")
    marked = edges.join(F.broadcast(few), "u", "left")
    return marked.filter("least is not null").select("u", "v", F.col("least").alias("m")).union(marked.filter("least is null").select("u", "v").join(low, "u").select("u", "v", "m"))


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node of edges (a, b); loops and repeats may occur.

    Each round is two joins against per-node minima (see with_least). Rounds are written, and each deletes
    the one before; their number grows with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    e, path = cluster.written_at(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both.filter("v > u"), both).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large, middle = cluster.written_at(large, name)
        small = with_least(large, large).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(large.groupBy("u").agg(F.min("v").alias("v")))
        before = path
        e, path = cluster.written_at(small.filter("u <> v").distinct(), name)
        for old in (before, middle):
            cluster.remove(spark, old)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
