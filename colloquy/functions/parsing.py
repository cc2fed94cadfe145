"""Reading fields, verdicts, evidence references and dates out of text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens at which a field of model output ends.
FORBIDDEN = ("<|", "##", "|>", "\n")


def clean_field(text: Column) -> Column:
    """Without one pair of quotes, cut at the first forbidden token, without trailing brackets, commas and quotes."""
    s = F.regexp_replace(F.trim(text), '^"(.*)"$', "$1")
    for token in FORBIDDEN:
        s = F.substring_index(s, token, 1)
    return F.trim(F.regexp_replace(s, '[\\s"\'),;]+$', ""))


def parse_yes_no(text: Column) -> Column:
    """1 for a first word yes or correct, 0 for no or wrong, else null."""
    w = F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), "[A-Za-z]+", 0))
    return F.when(w.isin("yes", "correct", "true"), 1).when(w.isin("no", "wrong", "incorrect", "false"), 0)


def parse_json_verdict(text: Column) -> Column:
    """1 or 0 from {"correct": ...} or {"label": "CORRECT" | "WRONG"}; a partial 0.5 becomes 0; else the word correct or wrong; else null."""
    v = F.try_parse_json(F.regexp_extract(F.coalesce(text, F.lit("")), "(?s)(\\{.*\\})", 1))
    flag, label = F.lower(F.try_variant_get(v, "$.correct", "string")), F.lower(F.try_variant_get(v, "$.label", "string"))
    lowered = F.lower(text)
    return (
        F.when(flag.isin("true", "1", "1.0", "yes"), 1)
        .when(flag.isNotNull(), 0)
        .when(label == "correct", 1)
        .when(label.isNotNull(), 0)
        .when(lowered.rlike("\\b(wrong|incorrect)\\b"), 0)
        .when(lowered.rlike("\\bcorrect\\b"), 1)
    )


def evidence_sessions(text: Column) -> Column:
    """Session numbers of references like D5:4; D8:3, ascending and distinct, comma-separated."""
    n = F.transform(F.regexp_extract_all(text, F.lit("D(\\d+):(\\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_join(F.transform(F.array_sort(F.array_distinct(n)), lambda x: x.cast("string")), ",")


def json_list(text: Column) -> Column:
    """An array of strings, or null if it is none."""
    return F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})


def retrieved_ids(ids: Column, context: Column) -> Column:
    """From a JSON list, else from the markers of the context."""
    return F.array_distinct(F.coalesce(json_list(ids), F.regexp_extract_all(context, F.lit("\\[sid=([^\\]]+)\\]"), F.lit(1))))


#: Words that make a question one about time, marks of an abstention, signs of a full context.
TIME_WORDS = "when date day week month year time before after since ago long recent".split()
ABSTAIN = ("not mentioned", "no information", "cannot be determined", "did not mention")
OVERFLOW = ("context length", "maximum context", "too many tokens", "context window", "token limit", "prompt is too long", "exceeds the limit", "reduce the length")


def asks_for_time(question: Column) -> Column:
    return F.lower(question).rlike("|".join(TIME_WORDS))


def abstains(gold: Column) -> Column:
    g = F.lower(F.trim(F.coalesce(gold, F.lit(""))))
    return g.isin("0", "0.", "0.0", "none") | g.rlike("|".join(ABSTAIN))


def is_overflow(message: Column) -> Column:
    return F.lower(message).rlike("|".join(OVERFLOW))


def gold_range(text: Column) -> tuple[Column, Column]:
    """First and last day of a gold date: 2023-05-07, 7 May 2023, May 7 2023, May 2023 or 2023; nulls for others."""
    s = F.regexp_replace(F.regexp_replace(F.trim(text), "(?i)(\\d)(st|nd|rd|th)\\b", "$1"), "[,\\s]+", " ")
    day = F.coalesce(*(F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-MM-dd", "d MMMM yyyy", "MMMM d yyyy"))).cast("date")
    month = F.try_to_timestamp(F.concat(F.lit("1 "), s), F.lit("d MMMM yyyy")).cast("date")
    year = F.when(s.rlike("^\\d{4}$"), F.make_date(s.try_cast("int"), F.lit(1), F.lit(1)))
    return F.coalesce(day, month, year), F.coalesce(day, F.last_day(month), F.add_months(year, 12) - F.expr("interval 1 day")).cast("date")


def weekday_before(day: Column, weekday: int) -> Column:
    """The last such weekday strictly before."""
    delta = F.pmod(F.weekday(day) - weekday, F.lit(7))
    return F.date_sub(day, F.when(delta == 0, 7).otherwise(delta))


def sentence_chunks(text: str | None, most: int) -> list[str]:
    """Pieces of at most `most` characters that end at a sentence where one ends in their second half."""
    out, s = [], (text or "").strip()
    while len(s) > most:
        ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", s[:most]) if m.end() >= most // 2]
        cut = ends[-1] if ends else most
        out.append(s[:cut].strip())
        s = s[cut:].strip()
    return [*out, s] if s else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunked(text: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([sentence_chunks(t, int(m)) for t, m in zip(text, most, strict=True)])


def facts(rows: DataFrame, key: str, answer: str, raw: str) -> DataFrame:
    """key, facts, n: the facts of a JSON list that are not blank, joined by a bar; the raw text where there is none."""
    found = F.filter(F.coalesce(json_list(F.col(answer)), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    return rows.select(key, F.when(F.size(found) > 0, F.array_join(found, " | ")).otherwise(F.col(raw)).alias("facts"), F.size(found).cast("long").alias("n"))


def says_yes(text: Column) -> Column:
    """1 or 0 of an answer that holds yes, else no, 1 or correct, each only where its opposite is not there as well; 0 where nothing decides."""
    v = F.lower(F.trim(F.coalesce(text, F.lit(""))))

    def only(a: str, b: str) -> Column:
        return F.contains(v, F.lit(a)) & ~F.contains(v, F.lit(b))

    return F.when(only("yes", "no"), 1).when(only("no", "yes"), 0).when(only("1", "0"), 1).when(only("correct", "incorrect"), 1).otherwise(0)


def graded_label(text: Column) -> Column:
    """1 correct, 0.5 partial, 0 wrong: of a JSON object with a label, else of the whole words in the text, where wrong and incorrect outweigh the others; null where none stands."""
    label = F.lower(F.trim(F.try_variant_get(F.try_parse_json(text), "$.label", "string")))
    v = F.lower(F.coalesce(text, F.lit("")))
    bad = v.rlike(r"\b(wrong|incorrect)\b")
    by_words = F.when(bad, 0.0).when(v.rlike(r"\bcorrect\b"), 1.0).when(v.rlike(r"\bpartial\b"), 0.5)
    return F.when(label == "correct", 1.0).when(label == "partial", 0.5).when(label == "wrong", 0.0).otherwise(by_words)
