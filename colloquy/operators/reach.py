"""Which gold turns the words of a question and of its answer can find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, once its text is in lower case.
WORD = "[a-z0-9][a-z0-9'-]*"


def words(text: Column, stopwords: list[str]) -> Column:
    """Distinct words in order, without stopwords and single letters; numbers stay."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))
    return F.filter(found, lambda w: ((F.length(w) > 1) | w.rlike("^[0-9]$")) & ~w.isin(stopwords))


def findable(text: Column) -> Column:
    """All that a search for a whole word finds in a text: its words, and the ends of words after an apostrophe or a hyphen ("re-read" holds "read", but not "re")."""
    whole = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))

    def ends(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.length(w)), lambda i: (i == 1) | (F.substr(w, i - 1, F.lit(1)).isin("'", "-") & F.substr(w, i, F.lit(1)).rlike("[a-z0-9]")))
        return F.transform(starts, lambda i: F.substr(w, i))

    return F.array_distinct(F.flatten(F.transform(whole, ends)))


def reached(questions: DataFrame, turns: DataFrame, most: int, stopwords: list[str]) -> DataFrame:
    """question, turn, any, useful, pair, answer of each gold turn: whether it holds a word of the question, one that at most `most` turns of the haystack hold,
    two words, and a word of the answer that the question lacks.

    questions: question, haystack, text, answer; turns: haystack, turn, text, gold. The turns are split once into an inverted index, and words meet it by equality.
    """
    index = turns.select("haystack", "turn", F.explode(findable(F.col("text"))).alias("word"))
    asked = questions.select("question", "haystack", words(F.col("text"), stopwords).alias("q"), words(F.col("answer"), stopwords).alias("a"))
    mine = asked.select("question", "haystack", F.explode("q").alias("word"))
    hits = mine.join(index, ["haystack", "word"])
    df = hits.groupBy("question", "word").agg(F.count("*").alias("df"))
    gold = turns.filter("gold").select("haystack", "turn")
    found = hits.join(gold, ["haystack", "turn"], "left_semi").join(df, ["question", "word"]).groupBy("question", "turn").agg(F.count("*").alias("n"), F.min("df").alias("least"))
    said = asked.select("question", "haystack", F.explode(F.array_except("a", "q")).alias("word")).join(index, ["haystack", "word"]).select("question", "turn").distinct().withColumn("said", F.lit(True))
    every = asked.select("question", "haystack").join(gold, "haystack").join(found, ["question", "turn"], "left").join(said, ["question", "turn"], "left")
    n, no = F.coalesce("n", F.lit(0)), F.lit(False)
    return every.select("question", "turn", (n > 0).alias("any"), F.coalesce(F.col("least") <= most, no).alias("useful"), (n > 1).alias("pair"), F.coalesce("said", no).alias("answer"))


def summary(flags: DataFrame) -> DataFrame:
    """Per question the number of gold turns and of those with each flag, and whether all are reached."""
    counts = (F.count_if(F.col(c)).alias(c) for c in ("any", "useful", "pair", "answer"))
    return flags.groupBy("question").agg(F.count("*").alias("n_gold"), *counts, F.bool_and("any").alias("all_any"), F.bool_and("useful").alias("all_useful"), F.bool_and(F.col("useful") | F.col("answer")).alias("all_useful_or_answer"))
