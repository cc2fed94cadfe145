"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column, floor: float = 1e-12) -> Column:
    """Divided by its length, which counts as `floor` at least."""
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(floor)))


def rescaled(weight: Column, cut: float) -> Column:
    """(w - cut) / (1 - cut), nothing at or below 0."""
    w = (F.greatest(weight, F.lit(0.0)) - cut) / (1 - cut)
    return F.when(w > 0, w)


def saturating_add(activation: Column, gain: Column) -> Column:
    return F.least(F.lit(1.0), activation + gain)
