import dataclasses

import pytest
from pyspark.sql import functions as F

from colloquy import settings
from colloquy.operators import bm25, contexts
from colloquy.plans.retrieval import letters
from colloquy.sources import store


@pytest.fixture(scope="module")
def kb(spark):
    """Each part is a table of its own below one folder, so that a plan's files tell what it reads."""
    path = store.shared_dir(spark, "kb")

    def stored(name, rows, schema, **more):
        spark.createDataFrame(rows, schema).withColumns(more).write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    entities = stored("entities", [(1, "blue car", "Thing", "fast", None), (2, "garage", "Place", "cold", None), (3, "zoo", "Place", "loud", None), (4, "monday", "Date", "a day", "2024-01-01")], "id long, name string, type string, description string, mentioned_at string", embedding=letters(F.col("name")))
    relations = stored("relations", [(10, 1, 2, "blue car -> garage", 0.9), (11, 2, 3, "garage -> zoo", 0.5), (12, 1, 4, "blue car -> monday", 1.0)], "id long, src long, dst long, label string, weight double", embedding=letters(F.col("label")))
    sources = stored("sources", [(1, 100), (2, 101), (4, 102)], "id long, sid long")
    summaries = stored("summaries", [(100, "d1", "the blue car is new"), (101, "d2", "a garage was built"), (102, "d3", "  "), (103, "d4", "a caar blue"), (104, "d5", "xyz")], "sid long, at string, text string", embedding=letters(F.col("text")))
    return contexts.Knowledge(entities, bm25.build(entities, "id", "name"), relations, sources, summaries)


PLAN = contexts.Plan(settings.Search(entity_topk=1, relation_topk=3, entity_threshold=0.9), settings.Activation(hops=1), settings.Evidence(direct_topn=2, direct_least=0.9))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "question long, text string")


def run(spark, kb, plan, *texts, **more):
    df = contexts.contexts(asked(spark, *texts), kb, plan, letters, **more)
    return df, {r.question: r.context for r in df.collect()}


def test_a_question_finds_its_context(spark, kb):
    _, got = run(spark, kb, PLAN, "where is the blue car", None, "qqq")
    graph, evidence = got[0].split("\n=== Evidence ===\n")
    # the garage and monday are one hop from the car, the zoo is two hops away
    assert graph.splitlines() == ["=== Entities ===", "- blue car (Thing): fast", "- garage (Place): cold", "- monday (Date): a day [mentioned_at: 2024-01-01]", "=== Relationships ===", "- blue car -> garage", "- blue car -> monday"]
    assert [x.split("] ")[1] for x in evidence.splitlines()] == ["the blue car is new"]  # what shares words; a blank text is none
    assert got[1] == "" and got[2] == ""


def reads(df):
    return {f.split("/")[-2] if "postings-" not in f else "names" for f in df.inputFiles()}


EVERYTHING = {"entities", "relations", "sources", "summaries", "names"}


def test_switches_take_scans_out_of_the_plan(spark, kb):
    plan = lambda **env: dataclasses.replace(PLAN, channels=settings.channels(env))
    text = "where is the blue car"
    df = contexts.contexts(asked(spark, text), kb, plan(), letters)
    assert reads(df) == EVERYTHING

    leaves = lambda df: df._jdf.queryExecution().analyzed().collectLeaves().size()
    for switch, fewer in (("NO_DENSE", True), ("NO_LEXICAL", True), ("NO_ACTIVATION", True), ("NO_RELATIONS", True), ("NO_DIRECT", True), ("NO_RERANK", False), ("NO_TIME_REWRITE", False)):
        out = contexts.contexts(asked(spark, text), kb, plan(**{switch: "1"}), letters)
        assert leaves(out) < leaves(df) if fewer else leaves(out) == leaves(df), switch
    assert reads(contexts.contexts(asked(spark, text), kb, plan(NO_LEXICAL="yes"), letters)) == EVERYTHING - {"names"}
    out, got = run(spark, kb, plan(NO_ACTIVATION="1", NO_DIRECT="1"), text)
    assert "garage" not in got[0] and "blue car (Thing)" in got[0]
    _, got = run(spark, kb, plan(NO_LEXICAL="1", NO_DENSE="1"), text)
    assert got[0].startswith("  • [d1][sid=100]") and "Entities" not in got[0]  # evidence is still found directly


def test_rewriting_of_time_and_rerank(spark, kb):
    rewrite = lambda t: F.replace(t, F.lit("yesterday"), F.lit("monday"))
    _, got = run(spark, kb, PLAN, "yesterday", rewrite=rewrite)
    assert "- monday (Date)" in got[0]
    _, off = run(spark, kb, dataclasses.replace(PLAN, channels=settings.channels({"NO_TIME_REWRITE": "1"})), "yesterday", rewrite=rewrite)
    assert "monday" not in off[0]
    few = dataclasses.replace(PLAN, kept_entities=1)
    _, got = run(spark, kb, few, "the garage of the blue car", rerank=lambda q, t: F.length(t).cast("double"))
    assert "- blue car (Thing)" in got[0] and "garage (" not in got[0]
