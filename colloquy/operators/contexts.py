"""From questions to their contexts in one composed plan, whose branches switches take out.

All questions go through every step at once; nothing is read for a channel that is switched off.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import settings
from colloquy.functions import models
from colloquy.functions import text as tx
from colloquy.functions import vector as vec
from colloquy.operators import bm25, evidence, knn, ranking


@dataclass(frozen=True)
class Knowledge:
    """What questions are answered from; ids are longs, embeddings arrays of one length."""

    entities: DataFrame  # id, name, type, description, mentioned_at, embedding
    names: bm25.Index  # over the entities, by id
    relations: DataFrame  # id, src, dst, label, weight (0 to 1), embedding (equal labels have equal ones)
    sources: DataFrame  # id (of an entity), sid
    summaries: DataFrame  # sid, at, text, embedding


@dataclass(frozen=True)
class Plan:
    """Settings of each step, and the channels that are left."""

    search: settings.Search = settings.Search()
    activation: settings.Activation = settings.Activation()
    evidence: settings.Evidence = settings.Evidence()
    kept_entities: int = 10
    kept_relations: int = 10
    narrowed: int = 8
    channels: frozenset[str] = settings.channels({})

    @staticmethod
    def switched(env: Mapping[str, str], **more) -> Plan:
        return Plan(channels=settings.channels(env), **more)


def seeds(asked: DataFrame, kb: Knowledge, plan: Plan) -> DataFrame:
    """question, id: entities near to the question's vector, and those whose names hold its words."""
    found = asked.select("question", F.lit(0).cast("long").alias("id")).limit(0)
    if "dense" in plan.channels:
        q = asked.select(F.col("question").alias("vec_id"), F.col("v").alias("embedding"))
        e = kb.entities.select(F.col("id").alias("vec_id"), "embedding")
        found = found.union(knn.top_k(q, e, plan.search.entity_topk, threshold=plan.search.entity_threshold, skip_self=False).select(F.col("qid").alias("question"), "id"))
    if "lexical" in plan.channels:
        scored = bm25.relative_cutoff(kb.names.scores(asked, "question", "text"), "question", plan.search.bm25_share, rounded=False)
        found = found.union(bm25.top(scored, "question", kb.names.key, plan.search.entity_topk).select("question", F.col(kb.names.key).alias("id")))
    return found.distinct()


def activated(start: DataFrame, relations: DataFrame, a: settings.Activation) -> DataFrame:
    """question, id: the seeds, and what they activate beyond `keep` over weighted edges taken both ways; a hop is one join and one sum."""
    weight = F.round((F.col("weight") - a.cut) / (1 - a.cut), 6)
    e = relations.select("src", "dst", weight.alias("w")).filter("w > 0")
    both = e.union(e.select("dst", "src", "w")).toDF("id", "to", "w")
    now = start.select("question", "id", F.lit(1.0).alias("a"))
    for _ in range(a.hops):
        gain = now.join(both, "id").groupBy("question", F.col("to").alias("id")).agg(F.sum(F.col("a") * F.col("w")).alias("gain"))
        now = now.join(gain, ["question", "id"], "full").select("question", "id", F.least(F.lit(1.0), F.coalesce("a", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("a"))
    return now.filter(F.round("a", 6) > a.keep).select("question", "id").union(start).distinct()


def related(asked: DataFrame, chosen: DataFrame, kb: Knowledge, plan: Plan, embed: Callable[[Column], Column]) -> DataFrame:
    """question, id of relations between chosen entities; where a question's keywords find relations, only those among them."""
    by_node = kb.relations.select("id", "src", "dst").join(chosen.withColumnRenamed("id", "src"), "src").join(chosen.withColumnRenamed("id", "dst"), ["question", "dst"]).select("question", "id").distinct()
    if "relations" not in plan.channels:
        return by_node
    words = asked.select("question", F.explode(tx.content_terms(F.col("text"))).alias("word"))
    each = words.select("word").distinct().select(F.xxhash64("word").alias("vec_id"), embed(F.col("word")).alias("embedding"))
    # of relations with one label only those with the smallest ids can be among the nearest, as ties go by id
    place = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    first = kb.relations.filter("id is not null").select("id", "label", "embedding").withColumn("_n", place).filter(F.col("_n") <= plan.search.relation_topk)
    hits = knn.top_k(each, first.select(F.col("id").alias("vec_id"), "embedding"), plan.search.relation_topk, threshold=plan.search.relation_threshold, skip_self=False)
    by_word = words.withColumn("qid", F.xxhash64("word")).join(hits, "qid").select("question", "id").distinct()
    both = by_node.join(by_word, ["question", "id"], "left_semi")
    return both.union(by_node.join(by_word.select("question").distinct(), "question", "left_anti"))


def kept(asked: DataFrame, items: DataFrame, label: str, most: int, plan: Plan, rerank: Callable[[Column, Column], Column]) -> DataFrame:
    """The first `most` items of each question with their rank: by the reranker's score of question and label, ties by id; by id alone without it."""
    score = F.round(rerank(F.col("question_text"), F.col(label)), 6) if "rerank" in plan.channels and plan.evidence.rerank else F.lit(0.0)
    scored = items.join(asked.select("question", F.col("text").alias("question_text")), "question").withColumn("score", score).drop("question_text")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= most)


def pool(asked: DataFrame, chosen: DataFrame, kb: Knowledge, plan: Plan) -> DataFrame:
    """question, sid, at, text, score (cosine to the question): summaries that the chosen entities come from, and those near to the question itself; blank ones go, and the best of each question stay."""
    sids = chosen.join(kb.sources, "id").select("question", "sid")
    if "direct" in plan.channels and plan.evidence.direct_topn:
        q = asked.select(F.col("question").alias("vec_id"), F.col("v").alias("embedding"))
        near = knn.top_k(q, kb.summaries.select(F.col("sid").alias("vec_id"), "embedding"), plan.evidence.direct_topn, threshold=plan.evidence.direct_least, skip_self=False)
        sids = sids.union(near.select(F.col("qid").alias("question"), F.col("id").alias("sid")))
    cosine = F.round(F.try_divide(vec.dot(F.col("embedding"), F.col("v")), vec.norm(F.col("embedding")) * vec.norm(F.col("v"))), 6)
    texts = kb.summaries.filter(F.trim("text") != "")
    scored = sids.distinct().join(texts, "sid").join(asked.select("question", "v"), "question").select("question", "sid", "at", "text", F.coalesce(cosine, F.lit(0.0)).alias("score"))
    return ranking.top_of(scored, "question", "sid", "score", plan.evidence.summary_topk)


def narrowed(asked: DataFrame, found: DataFrame, plan: Plan) -> DataFrame:
    """The pieces that share most words with the question, in the order of their score."""
    pos = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "sid"))
    terms = asked.select("question", tx.content_terms(F.col("text")).alias("terms"))
    items = found.withColumn("pos", pos).join(terms, "question").withColumn("overlap", tx.substring_overlap(F.col("terms"), F.col("text"))).drop("terms")
    return ranking.narrow(items, "question", "pos", "overlap", plan.narrowed)


def contexts(questions: DataFrame, kb: Knowledge, plan: Plan, embed: Callable[[Column], Column], rerank: Callable[[Column, Column], Column] = models.overlap_score, rewrite: Callable[[Column], Column] | None = None) -> DataFrame:
    """question, context of questions (question, text): the entities and relations kept for each, then its evidence.

    Steps: rewriting of phrases of time, seeds by vector and by words, activation over the graph, relations between what is active, a rerank of
    each, evidence from sources and directly, and narrowing by words (of the question as it was asked). NO_TIME_REWRITE, NO_DENSE, NO_LEXICAL, NO_ACTIVATION,
    NO_RELATIONS, NO_RERANK and NO_DIRECT take a step out, together with all it would read. A question that finds nothing has an empty context.
    """
    said = questions.select("question", F.coalesce("text", F.lit("")).alias("original"))
    text = rewrite(F.col("original")) if rewrite and "time_rewrite" in plan.channels else F.col("original")
    asked = said.select("question", "original", text.alias("text")).withColumn("v", embed(F.col("text")))
    start = seeds(asked, kb, plan)
    active = activated(start, kb.relations, plan.activation) if "activation" in plan.channels else start
    entities = kept(asked, active.join(kb.entities.select("id", "name", "type", "description", "mentioned_at"), "id"), "name", plan.kept_entities, plan, rerank)
    relations = kept(asked, related(asked, active, kb, plan, embed).join(kb.relations.select("id", "label"), "id"), "label", plan.kept_relations, plan, rerank)
    shown = evidence.render_graph(entities, relations, "question")
    pieces = narrowed(asked.select("question", F.col("original").alias("text")), pool(asked, entities, kb, plan), plan)
    line = F.concat(F.format_string("  • [%s][sid=%s][score=%.3f] ", F.col("at").cast("string"), F.col("sid").cast("string"), F.col("score")), F.col("text"))
    block = pieces.groupBy("question").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"))
    both = shown.join(block, "question", "full").select("question", F.concat_ws("\n=== Evidence ===\n", "context", "block").alias("context"))
    return said.select("question").join(both, "question", "left").select("question", F.coalesce("context", F.lit("")).alias("context"))
