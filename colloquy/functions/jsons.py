"""JSON of unknown shape: its strings and numbers, compact forms, dotted values, and reports as text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAVES = T.StructType([T.StructField("strings", T.ArrayType(T.StringType())), T.StructField("ints", T.ArrayType(T.LongType()))])


def leaves(value) -> tuple[list[str], list[int]]:
    """Strings and whole numbers of a decoded value, level by level; truth values count as neither."""
    strings, ints, level = [], [], [value]
    while level:
        below: list = []
        for x in level:
            if isinstance(x, dict):
                below += x.values()
            elif isinstance(x, list):
                below += x
            elif isinstance(x, str):
                strings.append(x)
            elif isinstance(x, int) and not isinstance(x, bool):
                ints.append(x)
        level = below
    return strings, ints


@F.pandas_udf(LEAVES)
def flattened(text: pd.Series) -> pd.DataFrame:
    """leaves of each JSON text; empty for what is none."""
    out = []
    for t in text:
        try:
            out.append(leaves(json.loads(t)))
        except (TypeError, ValueError):
            out.append(([], []))
    return pd.DataFrame(out, columns=["strings", "ints"])


def compact(text: Column) -> Column:
    """JSON without white space, the keys of objects in order; null for what is none."""
    return F.to_json(F.try_parse_json(text))


def number(text: Column) -> Column:
    """A double, or null for a blank or what is no number: a missing value is not a zero."""
    return F.trim(text).try_cast("double")


def dotted(text: Column, path: str) -> Column:
    """The value at a dotted path as a double, or null."""
    return F.try_variant_get(F.try_parse_json(text), f"$.{path}", "string").try_cast("double")


def case_row(text: Column, paths: dict[str, str]) -> list[Column]:
    """Columns of a nested case by their dotted paths, as text; null where the path leads nowhere."""
    v = F.try_parse_json(text)
    return [F.try_variant_get(v, f"$.{p}", "string").alias(name) for name, p in paths.items()]


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part/whole as text, n/a without a whole."""
    return F.when(whole == 0, "n/a").otherwise(F.format_string(f"%.{digits}f", part.cast("double") / whole))


def table_row(*cells: Column) -> Column:
    """A row of a Markdown table; null is blank, a bar in a cell is escaped."""
    shown = [F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))
