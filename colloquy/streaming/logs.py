"""Event logs joined by request while they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partnered(requests: DataFrame, answers: DataFrame, key: str, within: str = "10 minutes", late: str = "5 minutes", ts: str = "ts") -> DataFrame:
    """Each request (key, ts, and more) with the answers (key, ts, and more) under its key that come within a time of it, or with nulls.

    A left outer join in time, for streams and tables alike. On streams both sides have a watermark, so the state holds what can still meet: a request
    without an answer comes out once the watermark has passed its time by `within`, and an answer later than `late` is dropped. A null key meets nothing. Columns of
    answers get the prefix answer_.
    """
    a = answers.select(*(F.col(f"`{c}`").alias(f"answer_{c}") for c in answers.columns)).withWatermark(f"answer_{ts}", late)
    r = requests.withWatermark(ts, late)
    met = (r[key] == a[f"answer_{key}"]) & (a[f"answer_{ts}"] >= r[ts]) & (a[f"answer_{ts}"] <= r[ts] + F.expr(f"interval {within}"))
    return r.join(a, met, "left_outer").drop(f"answer_{key}")
