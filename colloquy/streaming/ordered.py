"""Turns taken in strictly in order, whatever order they arrive in, with the entities of each conversation as keyed state."""

from __future__ import annotations

import json
from collections.abc import Generator, Iterator
from contextlib import contextmanager
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MENTION = "conv_id long, turn long, name string, action string, mentions long, first_turn long, previous_turn long"
COLUMNS = [c.split()[0] for c in MENTION.split(", ")]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which state by map and timer needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Entities:
    """The entities of one conversation: name -> [first turn, last turn, mentions], as JSON in blocks by a hash of the name.

    A call to the state costs far more than a mention, so a block is read and written once however many of its names are mentioned. The number of
    blocks doubles with the entities: what a mention reads is bounded, and a conversation of few entities has one block.
    """

    BLOCK = 256

    def __init__(self, state, blocks: int, known: int):
        self.state, self.blocks, self.known, self.there, self.held = state, blocks, known, known > 0, {}

    def _block(self, b: int) -> dict:
        if b not in self.held:
            self.held[b] = json.loads(self.state.getValue((b,))[0]) if self.there else {}
        return self.held[b]

    def mention(self, name: str, turn: int) -> tuple[int, int, int | None]:
        """Its mentions with this one, its first turn and the turn before."""
        block = self._block(crc32(name.encode()) % self.blocks)
        first, last, n = block.get(name) or (turn, None, 0)
        self.known += n == 0
        block[name] = [first, turn, n + 1]
        return n + 1, first, last

    def save(self) -> None:
        if self.known > self.BLOCK * self.blocks:
            every = [kv for b in range(self.blocks) for kv in self._block(b).items()]
            while self.known > self.BLOCK * self.blocks:
                self.blocks *= 2
            self.held = {b: {} for b in range(self.blocks)}
            for name, figures in every:
                self.held[crc32(name.encode()) % self.blocks][name] = figures
        for b, block in self.held.items():
            self.state.updateValue((b,), (json.dumps(block),))
        self.there, self.held = self.known > 0, {}


class Ingest(StatefulProcessor):
    """State of one conversation: turns that wait, its entities, the number that comes next and the time of the latest turn.

    A turn is taken when all numbers before it have been, or when the watermark passes its time: what is missing then is given up, and turns before it that
    wait are taken first. A turn that comes after its place was given up, or a second time, is passed over. Each name of a turn is an ADD at its first mention and
    an UPDATE later. After idle_ms of event time without a turn the conversation's state goes; a turn after that starts anew. Only turns that wait enter the state.
    """

    ROWS = 50_000  # of a frame that is handed on

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, latest long, waits long, due long, blocks long, known long")  # due: no turn that waits has an earlier time
        self.waiting = handle.getMapState("waiting", "turn long", "at long, names string")
        self.entities = handle.getMapState("entities", "block long", "held string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        there = self.place.exists()
        after, before, waits, due, blocks, known = self.place.get() if there else (0, 0, 0, 0, 1, 0)
        latest, entities = before, Entities(self.entities, blocks, known)
        for batch in rows:
            came: dict[int, tuple] = {}
            for turn, at, names in zip(batch["turn"], batch["ts"], batch["names"], strict=True):
                ms = int(at.timestamp() * 1000)
                latest = max(latest, ms)
                if turn < after or turn in came or waits and self.waiting.containsKey((int(turn),)):
                    continue
                came[int(turn)] = (ms, [] if names is None else list(names))
            after, waits = yield from self._released(key, after, waits, entities, came, [])
            for turn, (ms, names) in came.items():
                self.waiting.updateValue((turn,), (ms, json.dumps(names)))
                if not waits or ms < due:
                    due = ms
                    self.handle.registerTimer(due)
                waits += 1
            entities.save()
        if latest > before or not there:
            self.handle.registerTimer(latest + self.idle_ms)
        self.place.update((after, latest, waits, due, entities.blocks, entities.known))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.place.exists():
            return
        after, latest, waits, due, blocks, known = self.place.get()
        now = timerValues.getCurrentWatermarkInMs()
        if waits and due <= now:
            entities = Entities(self.entities, blocks, known)
            times = {t[0]: at for t, (at, _) in self.waiting.iterator()}
            last = max((t for t, at in times.items() if at <= now), default=-1)
            after, waits = yield from self._released(key, after, waits, entities, {}, sorted(t for t in times if t <= last))
            entities.save()
            if waits:
                due = min(at for t, at in times.items() if t >= after)
                self.handle.registerTimer(due)
            self.place.update((after, latest, waits, due, entities.blocks, entities.known))
        if now >= latest + self.idle_ms:
            for state in (self.place, self.waiting, self.entities):
                state.clear()

    def _released(self, key, after: int, waits: int, entities: Entities, came: dict[int, tuple], due: list[int]) -> Generator[pd.DataFrame, None, tuple[int, int]]:
        """The mentions of all turns that can be taken: those without a gap before them, of the state and of those that came, and those of the state that are due."""
        rows: list[tuple] = []
        over_gaps = iter(due)
        while True:
            if after in came:
                _, names = came.pop(after)
            elif waits and self.waiting.containsKey((after,)):
                names = json.loads(self.waiting.getValue((after,))[1])
                self.waiting.removeKey((after,))
                waits -= 1
            else:
                later = next((t for t in over_gaps if t > after), None)
                if later is None:
                    break
                after = later
                continue
            for name in names:
                n, first, last = entities.mention(name, after)
                rows.append((key[0], after, name, "UPDATE" if n > 1 else "ADD", n, first, last))
            after += 1
            if len(rows) >= self.ROWS:
                yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)  # most frames are small, so finding out types would take longer than the rest
        return after, waits

    def close(self) -> None:
        pass


def ingest(stream: DataFrame, late: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """Mentions of a stream of turns (conv_id, turn, ts, names: array without repeats), numbered from 0: see Ingest. Run it inside keyed_state.

    Rows of a conversation come out in the order of its turns, so a shuffled stream gives the rows of the sorted one as long as no turn is later than `late`.
    """
    turns = stream.select("conv_id", "turn", "ts", "names").withWatermark("ts", late)
    return turns.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=Ingest(idle_ms), outputStructType=MENTION, outputMode="Append", timeMode="EventTime")


def ingested(turns: DataFrame) -> DataFrame:
    """The same rows for turns that are all there, by windows."""
    named = turns.select("conv_id", "turn", F.explode("names").alias("name"))
    w = Window.partitionBy("conv_id", "name").orderBy("turn")
    n = F.row_number().over(w).cast("long")
    return named.select("conv_id", "turn", "name", F.when(n == 1, "ADD").otherwise("UPDATE").alias("action"), n.alias("mentions"), F.first("turn").over(w).alias("first_turn"), F.lag("turn").over(w).alias("previous_turn"))


def taken_in(stream: DataFrame, path: str, late: str = "10 minutes") -> DataFrame:
    """Run the stream as far as its source goes now; its mentions go to files below path, where a later run carries on."""
    spark = stream.sparkSession
    with keyed_state(spark):
        q = ingest(stream, late).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(MENTION).parquet(f"{path}/rows")
