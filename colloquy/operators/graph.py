"""Property graphs as vertex and edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """src, rel, dst in either direction."""
    return edges.select("src", "rel", "dst").union(edges.select(F.col("dst"), "rel", F.col("src")))


def one_hop(seeds: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, rel, neighbour of every known seed, with nulls for one without neighbours; a neighbour may be missing from the vertices (known is false)."""
    known = seeds.select("id").distinct().join(vertices.select("id"), "id", "left_semi")
    near = both_ways(edges).select(F.col("src").alias("id"), "rel", F.col("dst").alias("neighbour"))
    v = vertices.select(F.col("id").alias("neighbour"), F.lit(True).alias("known"))
    return known.join(near, "id", "left").join(v, "neighbour", "left").select("id", "rel", "neighbour", F.when(F.col("neighbour").isNotNull(), F.coalesce("known", F.lit(False))).alias("known"))


def with_endpoints(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges whose two ends exist, with their names."""
    s = vertices.select(F.col("id").alias("src"), F.col("name").alias("src_name"))
    t = vertices.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    return edges.join(s, "src").join(t, "dst")


def dangling(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    ids = vertices.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").union(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "rel", "dst")).distinct()


def frontier(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """id, hop: vertices first reached after so many steps in either direction; seeds have hop 0. The plan holds one join and one anti join a hop."""
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    edge, new = both_ways(edges).select("src", "dst").distinct(), seen
    for h in range(1, hops + 1):
        new = new.join(edge, new.id == edge.src).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(h))
        seen = seen.union(new)
    return seen


def edge_weights(edges: DataFrame, scores: DataFrame, cut: float) -> DataFrame:
    """Edges with weight (score - cut) / (1 - cut); a missing or negative score is 0, and an edge at or below 0 goes."""
    w = (F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)) - cut) / (1 - cut)
    return edges.join(scores, "rel", "left").withColumn("weight", F.round(w, 6)).drop("score").filter("weight > 0")


def activation_sync(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """a(t+1) = min(1, a(t) + sum of weight * a(t) of the neighbours), for seeds (id, activation) and edges (src, dst, weight) taken both ways."""
    e = edges.select("src", "dst", "weight").union(edges.select(F.col("dst"), F.col("src"), "weight"))
    a = seeds.select("id", F.col("activation").cast("double").alias("activation"))
    for _ in range(hops):
        gain = a.join(e, a.id == e.src).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("activation") * F.col("weight")).alias("gain"))
        a = a.join(gain, "id", "full").select("id", F.least(F.lit(1.0), F.coalesce("activation", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("activation"))
    return a.withColumn("activation", F.round("activation", 6))


def spreading_activation(seeds: DataFrame, edges: DataFrame, hops: int = 2, cut: float = 0.4, keep: float = 0.5) -> DataFrame:
    """Order-dependent spreading per question: seeds (question, id, activation), edges (question, src, dst, weight) already limited to the question's neighbourhood.

    First in, first out from the seeds in id order; an edge passes (w - cut) / (1 - cut) if positive, a
    neighbour gains min(1, a + w * a_from) whether it was visited or not, and is queued when first met
    and within the hops. Returns question, id, activation of seeds and of vertices with at least `keep`. One group is one
    question's neighbourhood, which the hops and the cut bound.
    """
    def spread(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for s, d, w in right[["src", "dst", "weight"]].sort_values(["src", "dst"]).itertuples(index=False):
            w = (max(w, 0.0) - cut) / (1 - cut)
            if w > 0:
                near.setdefault(s, []).append((d, w))
                near.setdefault(d, []).append((s, w))
        act = dict(left.sort_values("id")[["id", "activation"]].itertuples(index=False))
        seeds_, depth = set(act), dict.fromkeys(act, 0)
        queue = list(act)
        for node in queue:
            if depth[node] >= hops:
                continue
            for other, w in sorted(near.get(node, [])):
                act[other] = min(1.0, act.get(other, 0.0) + w * act[node])
                if other not in depth:
                    depth[other] = depth[node] + 1
                    queue.append(other)
        rows = [(key[0], k, round(v, 6)) for k, v in act.items() if k in seeds_ or v >= keep]
        return pd.DataFrame(rows, columns=["question", "id", "activation"])

    schema = f"question {seeds.schema['question'].dataType.simpleString()}, id {seeds.schema['id'].dataType.simpleString()}, activation double"
    return seeds.groupBy("question").cogroup(edges.groupBy("question")).applyInPandas(spread, schema)


def upsert_vertices(current: DataFrame, new: DataFrame) -> DataFrame:
    """id, name, type, description: of equal new ids the last by seq counts; known name and type stay unless null, the description is overwritten."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))).filter("_n = 1")
    n = last.select("id", F.col("name").alias("n_name"), F.col("type").alias("n_type"), F.col("description").alias("n_description"))
    return current.join(n, "id", "full").select("id", F.coalesce("name", "n_name").alias("name"), F.coalesce("type", "n_type").alias("type"), F.coalesce("n_description", "description").alias("description"))


def upsert_edges(current: DataFrame, new: DataFrame, vertices: DataFrame) -> DataFrame:
    """rel, src, dst, description, strength: new rows without an id or an end are dropped, those to unknown vertices too; of equal rel the last by seq overwrites. strength becomes an int or null."""
    ids = vertices.select("id")
    ok = new.filter("rel is not null and src is not null and dst is not null")
    ok = ok.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    last = ok.withColumn("_n", F.row_number().over(Window.partitionBy("rel").orderBy(F.desc("seq")))).filter("_n = 1")
    fresh = last.select("rel", "src", "dst", "description", F.expr("try_cast(strength as int)").alias("strength"))
    return current.select("rel", "src", "dst", "description", "strength").join(fresh, "rel", "left_anti").unionByName(fresh)


def missing_ids(expected: DataFrame, actual: DataFrame, key: str = "id") -> DataFrame:
    return expected.select(key).distinct().join(actual.select(key), key, "left_anti")
