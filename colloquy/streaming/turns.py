"""Structured Streaming over turns and events: dedup, windows, pairing, upserts and joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colloquy.sources import merge

TURN = "conv_id long, turn long, role string, text string, ts timestamp"


def turns(spark: SparkSession, path: str, schema: str = TURN, files: int = 64) -> DataFrame:
    """New files of a folder, at most so many a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def dedup(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key; state is kept as long as the watermark needs it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, keys: list[str], size: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, size).alias("w")).agg(F.count("*").alias("n")).select(*keys, "w.start", "w.end", "n")


def sessions(stream: DataFrame, keys: list[str], gap: str = "30 minutes", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select(*keys, "s.start", "s.end", "n")


PAIR = "conv_id long, message_id long, user_text string, assistant_text string"


def pair(stream: DataFrame, ts: str = "ts", wait_ms: int = 7_200_000) -> DataFrame:
    """Turn pairs as they complete: the pending user turn of a conversation is the only state, kept until the watermark has passed its time by wait_ms.

    The stream needs a watermark on `ts`. Turns of a conversation are taken in order of their number within a trigger; an
    assistant turn without a user turn before it is paired with an empty text, other roles are passed over.
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        waiting, latest = state.get if state.exists else (None, 0)
        rows = []
        for t in pd.concat(list(batches)).sort_values("turn").itertuples(index=False):
            latest = max(latest, int(getattr(t, ts).timestamp() * 1000))
            if t.role == "user":
                waiting = t.text
            elif t.role == "assistant":
                rows.append((key[0], t.turn, waiting or "", t.text))
                waiting = None
        state.update((waiting, latest))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + wait_ms)
        yield pd.DataFrame(rows, columns=["conv_id", "message_id", "user_text", "assistant_text"])

    return stream.groupBy("conv_id").applyInPandasWithState(step, PAIR, "waiting string, latest long", "append", GroupStateTimeout.EventTimeTimeout)


def with_static(stream: DataFrame, static: DataFrame, keys: list[str]) -> DataFrame:
    return stream.join(static, keys, "left")


def upsert_to(stream: DataFrame, path: str, schema: str, keys: list[str], order: str, checkpoint: str, buckets: int = 64) -> DataStreamWriter:
    """Each micro-batch merged into a table in place (see merge): the last row of a key replaces the old one, and only its bucket is rewritten. A batch that runs again after a failure gives the same table."""
    def bring_in(batch: DataFrame, number: int) -> None:
        if not merge.exists(batch.sparkSession, path):
            merge.create(batch.sparkSession.createDataFrame([], schema), path, keys, buckets)
        merge.merge(batch, path, schema, keys, order, buckets)

    return stream.writeStream.foreachBatch(bring_in).option("checkpointLocation", checkpoint).trigger(availableNow=True)
