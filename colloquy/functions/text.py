"""Text expressions: tokens, overlaps, scores of answers, identifiers and markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the lexical index leaves out.
STOPWORDS = (
    "the a an in on at for to from of and or but with without is are was were be been being it its they them this that "
    "these those as by into over under up down"
).split()

#: Shapes of dates that are kept as they stand, year first, or month and day between white space.
DATE_TOKENS = ("\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}", "(?<!\\S)\\d{1,2}/\\d{1,2}(?!\\S)")


def tokens(text: Column, least: int = 3) -> Column:
    """Lower-case letter runs of at least `least` letters that are not stopwords, in order, repeats kept."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z]{{{least},}}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def dated_tokens(text: Column, least: int = 3) -> Column:
    """tokens, with dates as tokens of their own."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("|".join([*DATE_TOKENS, f"[a-z]{{{least},}}"])), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def content_terms(text: Column) -> Column:
    """Distinct tokens in order of first occurrence."""
    return F.array_distinct(tokens(text))


def substring_overlap(terms: Column, text: Column) -> Column:
    """How many of the terms occur anywhere in the text."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(terms, lambda t: F.contains(lowered, t)))


def token_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def simple_tokens(text: Column) -> Column:
    """Lower case, the marks . , ! ? as spaces, split at white space."""
    plain = F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), ".,!?", "    "), "\\s+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 on token sets; 0 when either is empty or nothing is shared."""
    p, g = F.array_distinct(prediction), F.array_distinct(gold)
    common = F.size(F.array_intersect(p, g))
    precision, recall = common / F.size(p), common / F.size(g)
    return F.when((F.size(p) == 0) | (F.size(g) == 0) | (common == 0), 0.0).otherwise(2 * precision * recall / (precision + recall))


def bleu1(prediction: Column, gold: Column) -> Column:
    """Clipped unigram precision with a brevity penalty; 0 without a match."""
    n, m = F.size(prediction), F.size(gold)

    def times(arr: Column, w: Column) -> Column:
        return F.size(F.filter(arr, lambda x: x == w))

    clipped = F.aggregate(F.array_distinct(prediction), F.lit(0), lambda acc, w: acc + F.least(times(prediction, w), times(gold, w)))
    penalty = F.when(n > m, 1.0).otherwise(F.exp(1 - m / n))
    return F.when((n == 0) | (m == 0) | (clipped == 0), 0.0).otherwise(penalty * clipped / n)


def slug(text: Column) -> Column:
    """Trimmed, lower case, then spaces, slashes and double colons as underscores, in that order."""
    s = F.lower(F.trim(text))
    for old in (" ", "/", "::"):
        s = F.replace(s, F.lit(old), F.lit("_"))
    return s


def entity_id(kind: Column, name: Column) -> Column:
    return slug(F.concat(kind, F.lit("::"), name))


def relation_id(source: Column, target: Column) -> Column:
    """Depends on the direction."""
    return slug(F.concat(source, F.lit("::"), target))


def normal_name(name: Column) -> Column:
    """Trimmed, lower case, white space collapsed. Compatibility forms are folded before it, by models.nfkc, where names are compared."""
    return F.regexp_replace(F.lower(F.trim(name)), "\\s+", " ")


def normal_answer(text: Column, most: int = 200) -> Column:
    """Lower-case letters, digits and underscores with single spaces, at most `most` characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", " ")), 1, most)


def snippet(text: Column, pattern: str, around: int = 90) -> Column:
    """The first match with up to `around` characters on both sides, dots where the text goes on; null without a match."""
    found = F.regexp_substr(text, F.lit(pattern))
    at = F.instr(text, found)
    start = F.greatest(F.lit(1), at - around)
    stop = F.least(F.length(text), at + F.length(found) - 1 + around)
    return F.when(found.isNull(), None).otherwise(
        F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, stop - start + 1), F.when(stop < F.length(text), "...").otherwise(""))
    )


def marker(text: Column, pattern: str, group: int = 1) -> Column:
    """All matches of one group of a marker pattern."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def scrub(text: Column) -> Column:
    """Without <|...|> tags, <think> blocks and end tokens."""
    s = F.regexp_replace(text, "(?s)<think>.*?</think>", "")
    s = F.regexp_replace(s, "<\\|[^|>]*\\|>", "")
    return F.trim(F.regexp_replace(s, "</s>", ""))


def entity_text(name: Column, kind: Column, description: Column) -> Column:
    """name [type=kind] description, or kind description without a name."""
    d = F.coalesce(description, F.lit(""))
    return F.trim(F.when(F.coalesce(name, F.lit("")) == "", F.concat(kind, F.lit(" "), d)).otherwise(F.concat(name, F.lit(" [type="), kind, F.lit("] "), d)))


def relation_text(source: Column, target: Column, description: Column, keywords: Column) -> Column:
    return F.concat(source, F.lit(" -> "), target, F.lit(" | "), description, F.lit(" (keywords: "), keywords, F.lit(")"))


def truncated(text: Column, most: int = 3000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def display_turn(role: Column, text: Column, most: int) -> Column:
    """User or Assistant label, white space collapsed, truncated."""
    label = F.when(role == "user", "User : ").otherwise("Assistant : ")
    return F.substring(F.concat(label, F.trim(F.regexp_replace(text, "\\s+", " "))), 1, most)
