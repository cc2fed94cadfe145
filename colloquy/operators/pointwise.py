"""A pointwise reranker: how much likelier yes is than no, read off a model's recorded answers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the log-probability of a token that is not among those an answer lists.
ABSENT = -100.0


def prompt(instructions: Mapping[str, str], kind: Column, question: Column, text: Column) -> Column:
    """What a model is asked: the instruction of the kind of document, the question and the document; null for a kind without an instruction."""
    said = F.create_map(*(F.lit(x) for pair in instructions.items() for x in pair))
    return F.concat(said[kind], F.lit("\nQuestion: "), F.coalesce(question, F.lit("")), F.lit("\nDocument: "), F.coalesce(text, F.lit("")))


def score(top: Column, text: Column) -> Column:
    """log P(yes) - log P(no) among the listed first tokens (array of token, logprob): case, spaces and word marks around a token do not matter, the first of several counts, an absent one has ABSENT.

    Without a list the answer's text decides: 1 if it begins with yes, else -1.
    """

    def of(word: str) -> Column:
        same = F.filter(top, lambda t: F.btrim(F.lower(t["token"]), F.lit("▁ ")) == word)
        return F.coalesce(F.get(same, F.lit(0))["logprob"], F.lit(ABSENT))

    by_text = F.when(F.startswith(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit("yes")), 1.0).otherwise(-1.0)
    return F.when(F.size(F.coalesce(top, F.array().cast("array<struct<token: string, logprob: double>>"))) > 0, of("yes") - of("no")).otherwise(by_text)


def reranked(pairs: DataFrame, answers: DataFrame, instructions: Mapping[str, str], threshold: float | None = None) -> DataFrame:
    """question, kind, id, score, rank of pairs (question, question_text, kind, id, text): the highest score first within a question and kind, ties by id; those from the threshold on.

    answers: key (SHA-256 of the prompt), top, text. A pair without a recorded answer has no score and comes last, or goes with a threshold. Equal prompts, whatever their number, are one answer.
    """
    asked = pairs.withColumn("key", F.sha2(prompt(instructions, F.col("kind"), F.col("question_text"), F.col("text")), 256))
    told = answers.select("key", score(F.col("top"), F.col("text")).alias("score")).dropDuplicates(["key"])
    scored = asked.join(told, "key", "left").withColumn("score", F.round("score", 6))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("question", "kind").orderBy(F.desc_nulls_last("score"), "id")))
    out = best.select("question", "kind", "id", "score", "rank")
    return out if threshold is None else out.filter(F.col("score") >= threshold)
