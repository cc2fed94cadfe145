"""Interfaces to models, with deterministic stand-ins that need no network.

A model is a function over pandas series that Spark runs a batch at a time; a real one loads
once per worker in the iterator form.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hash_vector(text: str | None, dim: int = 64) -> list[float]:
    """Signed token counts by hash, of length 1; zeros without tokens."""
    v = np.zeros(dim)
    for w in re.findall(r"\w+", (text or "").lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1 if h >> 63 else -1
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).tolist()


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None, dim: int = 64):
    """A column function text -> array<double>. load: returns the model, called once per worker."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load() if load else lambda texts: [hash_vector(t, dim) for t in texts]
        for batch in batches:
            yield pd.Series(model(batch.tolist()), index=batch.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))


def overlap_score(query: Column, text: Column) -> Column:
    """Stand-in reranker: share of the query's terms that the text holds, as a logit between -5 and 5."""
    from colloquy.functions.text import content_terms

    q, t = content_terms(query), content_terms(text)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)), F.size(q)), F.lit(0.0)) * 10 - 5


def reranker(load: Callable[[], Callable[[list[str], list[str], list[str]], list[float]]]):
    """A column function (query, text, kind) -> double around a model that is loaded once per worker."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t, k in batches:
            yield pd.Series(model(q.tolist(), t.tolist(), k.tolist()), dtype="float64", index=q.index)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.DoubleType())


def replayed(requests: DataFrame, answers: DataFrame, prompt: str) -> DataFrame:
    """Stand-in language model: answers (key, answer) recorded by the SHA-256 of the prompt; null where there is none."""
    return requests.withColumn("_k", F.sha2(F.col(prompt), 256)).join(answers.select(F.col("key").alias("_k"), "answer"), "_k", "left").drop("_k")


def compressed(text: Column, words: int = 60) -> Column:
    """Stand-in compressor: the first words."""
    return F.array_join(F.slice(F.split(F.trim(text), "\\s+"), 1, words), " ")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility form of Unicode; Spark has no built-in."""
    return text.str.normalize("NFKC")
