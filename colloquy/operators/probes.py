"""Case probes: at which step of the way a question's evidence was lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The steps in their order, and what is said of a case whose first failure is there.
STEPS = {
    "ingest": "ingest failed", "gold": "no gold marked", "summary": "no summary of the gold turns", "extraction": "nothing extracted from them", "pool": "no target entered the pool",
    "filter": "cut", "evidence": "no target reached the evidence", "answer": "all was there, the answer is wrong",
}


def targets(summed: DataFrame, extracted: DataFrame, searched: DataFrame, filtered: DataFrame, evidence: DataFrame, recovered: DataFrame) -> DataFrame:
    """case, id of every target (what was extracted from a case's summed turns), with what the logs say of it: searched, above, within, evidence, recovered.

    All logs are grouped at once, so each is read once and its rows are moved once. An id that no filter has judged has null in above and within, as has one without an id.
    """
    none, columns = F.lit(None).cast("boolean"), ("target", "searched", "above", "within", "evidence", "recovered")
    told = lambda rows, **has: rows.select("case", "id", *(has.get(c, none).alias(c) for c in columns))
    known = lambda rows: rows.filter(F.col("id").isNotNull())
    every = told(extracted.join(summed, ["case", "sid"], "left_semi"), target=F.lit(True)).union(told(known(filtered), above=F.col("above"), within=F.col("within")))
    for name, rows in (("searched", searched), ("evidence", evidence), ("recovered", recovered)):
        every = every.union(told(known(rows), **{name: F.lit(True)}))
    return every.groupBy("case", "id").agg(*(F.bool_and(c).alias(c) for c in columns)).filter("target").drop("target")


def first_failing(cases: DataFrame, ingested: DataFrame, gold: DataFrame, summaries: DataFrame, extracted: DataFrame, searched: DataFrame, filtered: DataFrame, evidence: DataFrame, recovered: DataFrame) -> DataFrame:
    """case, step, cause of every case: the first step that fails it.

    ingested: case of those that went in; recovered: case, id of targets that came back after a cut. A case fails at the filter if any of its targets was cut there,
    by threshold, top-k or both, and its cause says whether one of them was recovered. A log that lacks a case fails it at that step; see targets for the rest.
    """
    summed = gold.select("case", "sid").distinct().join(summaries, ["case", "sid"], "left_semi")
    gone = F.coalesce(F.col("searched") & ~(F.col("above") & F.col("within")), F.lit(False))
    some = lambda x: F.bool_or(F.coalesce(x, F.lit(False)))
    met = targets(summed, extracted, searched, filtered, evidence, recovered).withColumn("cut", gone)
    steps = met.groupBy("case").agg(
        F.lit(True).alias("_extraction"), F.bool_or("searched").alias("_pool"), F.when(some(F.col("searched") & ~F.col("cut") & F.col("evidence")), True).alias("_evidence"),
        some(F.col("cut") & ~F.col("above")).alias("low"), some(F.col("cut") & ~F.col("within")).alias("late"), F.when(F.bool_or("cut"), F.count_if(F.col("cut") & F.col("recovered"))).alias("back"),
    )
    told = cases.select("case").distinct().join(ingested.select("case").distinct().withColumn("_ingest", F.lit(True)), "case", "left")
    for step, rows in (("gold", gold), ("summary", summed)):
        told = told.join(rows.select("case").distinct().withColumn(f"_{step}", F.lit(True)), "case", "left")
    told = told.join(steps, "case", "left")
    first = F.when(F.col("_ingest").isNull(), "ingest")
    for step in ("gold", "summary", "extraction", "pool"):
        first = first.when(F.col(f"_{step}").isNull(), step)
    first = first.when(F.col("back").isNotNull(), "filter").when(F.col("_evidence").isNull(), "evidence").otherwise("answer")
    by = F.when(F.col("low") & F.col("late"), "by threshold and top-k").when(F.col("low"), "by threshold").otherwise("by top-k")
    how = F.concat_ws(" ", F.lit("cut"), by, F.when(F.col("back") > 0, "and recovered in part").otherwise("and not recovered"))
    said = F.create_map(*(F.lit(x) for pair in STEPS.items() for x in pair))
    return told.withColumn("step", first).select("case", "step", F.when(F.col("step") == "filter", how).otherwise(said[F.col("step")]).alias("cause"))
