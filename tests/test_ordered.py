import datetime as dt
import random
import types

import pandas as pd

from colloquy.streaming import logs, ordered

T0 = dt.datetime(2024, 1, 1)
TURN = "conv_id long, turn long, ts timestamp, names array<string>"


def turns(n=40):
    rng = random.Random(3)
    return [(c, i, T0 + dt.timedelta(seconds=10 * i + c), sorted(rng.sample(["ann", "bob", "cy", "dee"], rng.randint(0, 3)))) for c in (1, 2, 3) for i in range(n)]


def folder(spark, path, parts):
    for p in parts:
        spark.createDataFrame(p, TURN).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(TURN).option("maxFilesPerTrigger", 1).parquet(path)


def values(df):
    return sorted(map(tuple, df.select(*ordered.COLUMNS).collect()), key=str)


def test_a_shuffled_stream_gives_the_rows_of_the_sorted_one(spark, tmp_path):
    rows = turns()
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    stream = folder(spark, f"{tmp_path}/in", [mixed[:50], mixed[50:51] + mixed[:9], mixed[51:]])  # some arrive twice
    got = ordered.taken_in(stream, f"{tmp_path}/out", late="1 hour")
    assert values(got) == values(ordered.ingested(spark.createDataFrame(rows, TURN)))
    # a later run carries on with the state that the first one left
    more = [(1, 40, T0 + dt.timedelta(seconds=401), ["ann", "new"])]
    spark.createDataFrame(more, TURN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(TURN).parquet(f"{tmp_path}/in")
    assert values(ordered.taken_in(stream, f"{tmp_path}/out", late="1 hour")) == values(ordered.ingested(spark.createDataFrame(rows + more, TURN)))


def test_gaps_wait_for_the_watermark_and_idle_state_goes(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    first = [(1, 0, at(0), ["a"]), (1, 2, at(20), ["a", "b"]), (2, 1, at(10), ["z"])]
    later = [(9, 0, at(200), [])]  # moves the watermark past all of them
    on = lambda n, s: [(9, n, at(s), [])]  # noqa: E731  times are over one trigger after the watermark has passed them
    missing = [(1, 1, at(225), ["late"]), (1, 3, at(226), ["b"])]  # its place was given up
    anew = [(1, 0, at(100_020), ["a"]), *on(4, 300_000)]
    stream = folder(spark, f"{tmp_path}/in", [first, later, on(1, 220), missing, on(2, 100_000), on(3, 100_010), anew])
    with ordered.keyed_state(spark):
        q = ordered.ingest(stream, "1 second", idle_ms=3_600_000).writeStream.format("memory").queryName("gaps").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(300)
    got = values(spark.table("gaps"))
    assert got == sorted([(1, 0, "a", "ADD", 1, 0, None), (1, 2, "a", "UPDATE", 2, 0, 0), (1, 2, "b", "ADD", 1, 2, None), (2, 1, "z", "ADD", 1, 1, None), (1, 3, "b", "UPDATE", 2, 2, 2), (1, 0, "a", "ADD", 1, 0, None)], key=str)


REQUEST, ANSWER = "request_id string, ts timestamp, what string", "request_id string, ts timestamp, said string"


def test_late_and_missing_partners(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    asks = [[("a", at(0), "q1"), ("b", at(1), "q2"), ("c", at(2), "q3"), (None, at(2), "q4"), ("z", at(20), "q0")], [("d", at(60), "q5")], [("e", at(200), "q6")]]
    says = [[("a", at(3), "in time"), ("a", at(4), "again"), ("b", at(30), "too long after"), (None, at(2), "nobody's")], [("c", at(5), "dropped as late"), ("x", at(60), "of no request")], [("d", at(61), "in time, though its batch is later"), ("y", at(200), "")]]
    for n in range(3):  # one file of each side a trigger
        spark.createDataFrame(asks[n], REQUEST).coalesce(1).write.mode("append").parquet(f"{tmp_path}/asks")
        spark.createDataFrame(says[n], ANSWER).coalesce(1).write.mode("append").parquet(f"{tmp_path}/says")
        read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
        out = logs.partnered(read("asks", REQUEST), read("says", ANSWER), "request_id")
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(300)
    got = sorted((r.what, r.answer_said) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("q0", None), ("q1", "again"), ("q1", "in time"), ("q2", None), ("q3", None), ("q4", None), ("q5", "in time, though its batch is later")]  # q6 still waits
    whole = logs.partnered(spark.createDataFrame(sum(asks, []), REQUEST), spark.createDataFrame(sum(says, []), ANSWER), "request_id")
    on_a_table = [*(r for r in got if r[0] != "q3"), ("q3", "dropped as late"), ("q6", None)]
    assert sorted(((r.what, r.answer_said) for r in whole.collect()), key=str) == sorted(on_a_table, key=str)


class Kept(dict):
    """State of one key that counts what is asked of it."""

    calls = 0
    due: set = set()  # timers

    def __init__(self):
        Kept.calls, Kept.due = 0, set()

    def _counted(self, value=None):
        Kept.calls += 1
        return value

    exists = lambda self: self._counted("v" in self)
    getValueState = getMapState = lambda self, *_: Kept()
    registerTimer = lambda self, ms: self._counted(Kept.due.add(ms))
    get = lambda self, *_: self._counted(self["v"])
    update = lambda self, v: self._counted(self.__setitem__("v", v))
    containsKey = lambda self, k: self._counted(k in self)
    getValue = lambda self, k: self._counted(self[k])
    updateValue = lambda self, k, v: self._counted(self.__setitem__(k, v))
    removeKey = lambda self, k: self._counted(self.__delitem__(k))
    iterator = lambda self: self._counted(iter(list(self.items())))


def kept():
    p = ordered.Ingest(86_400_000)
    p.init(Kept())
    return p


def plain(frames):
    return [tuple(None if pd.isna(v) else v for v in r) for f in frames for r in f.itertuples(index=False)]


def came(p, *turns):
    rows = pd.DataFrame([(c, t, T0 + dt.timedelta(seconds=s), names) for c, t, s, names in turns], columns=["conv_id", "turn", "ts", "names"])
    return plain(p.handleInputRows((1,), iter([rows]), None))


def expired(p, s):
    now = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: int((T0 + dt.timedelta(seconds=s)).replace(tzinfo=dt.UTC).timestamp() * 1000))
    return plain(p.handleExpiredTimer((1,), now, None))


def by_hand(turns):
    seen, out = {}, []
    for c, t, _, names in turns:
        for n in names or []:
            first, last, k = seen.get(n, (t, None, 0))
            seen[n] = (first, t, k + 1)
            out.append((c, t, n, "UPDATE" if k else "ADD", k + 1, first, last))
    return out


def test_state_is_asked_by_conversation_not_by_mention():
    calls = {}
    for per_turn in (5, 50):
        p, asked = kept(), []
        given = [(1, t, t, [f"n{(7 * t + i) % 90}" for i in range(per_turn)]) for t in range(120)]
        for part in (given[:60], given[60:][::-1]):
            Kept.calls = 0
            assert came(p, *part) == by_hand(given)[len(asked) :][: 60 * per_turn]
            asked += [0] * 60 * per_turn
            calls[per_turn, len(asked) // per_turn] = Kept.calls
        assert len(Kept.due) == 2 and len(p.waiting) == 0
    assert max(calls.values()) <= 8 and calls[5, 60] == calls[50, 60] and calls[5, 120] == calls[50, 120]


def test_many_entities_are_split_into_blocks_that_are_asked_once():
    p, rng = kept(), random.Random(5)
    given = [(1, t, t, sorted(rng.sample([f"n{i}" for i in range(5_000)], 40)) if t % 9 else None) for t in range(400)]
    got = [r for n in range(0, 400, 50) for r in came(p, *given[n : n + 50])]
    assert got == by_hand(given)
    size = p.place["v"][-1]
    assert size == len({n for *_, names in given for n in names or []}) > 4_000 and len(p.entities) == 32
    Kept.calls = 0
    assert came(p, (1, 400, 400, ["n1"])) == by_hand([*given, (1, 400, 400, ["n1"])])[-1:]
    assert Kept.calls <= 6  # one block of 32


def test_turns_that_wait_are_taken_before_a_later_one_that_is_due():
    p = kept()
    assert came(p, (1, 0, 0, ["a"]), (1, 2, 500, ["a"]), (1, 3, 20, ["b"]), (1, 6, 30, ["a"]), (1, 9, 900, ["a"])) == [(1, 0, "a", "ADD", 1, 0, None)]
    assert came(p, (1, 2, 1, ["again"])) == [] and expired(p, 10) == []
    due = [(1, 2, "a", "UPDATE", 2, 0, 0), (1, 3, "b", "ADD", 1, 3, None), (1, 6, "a", "UPDATE", 3, 0, 2)]
    assert expired(p, 40) == due and sorted(p.waiting) == [(9,)] and p.place["v"][2] == 1
    assert expired(p, 40) == [] and came(p, (1, 1, 50, ["late"])) == []
    assert came(p, (1, 8, 60, ["b"]), (1, 7, 60, ["b"])) == [(1, 7, "b", "UPDATE", 2, 3, 3), (1, 8, "b", "UPDATE", 3, 3, 7), (1, 9, "a", "UPDATE", 4, 0, 6)]
    assert not p.waiting and p.place["v"][2] == 0
