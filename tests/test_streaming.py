import datetime as dt

from colloquy.sources import merge
from colloquy.streaming import turns as st


def test_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(c, i, r, f"{c}-{i}", t0 + dt.timedelta(minutes=c * 60 + i * 7)) for c in (1, 2) for i, r in enumerate(["user", "assistant", "system", "assistant", "user", "user", "assistant"])]
    first, second = rows[:9], rows[9:] + rows[:2]
    for n, part in enumerate((first, second)):
        spark.createDataFrame(part, st.TURN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = st.turns(spark, f"{tmp_path}/in", files=1)

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert len(run(st.dedup(stream, ["conv_id", "turn"]), "d")) == 14
    pairs = run(st.pair(st.dedup(stream, ["conv_id", "turn"])), "p")
    assert sorted((r.conv_id, r.message_id, r.user_text) for r in pairs) == [(c, m, u) for c in (1, 2) for m, u in ((1, f"{c}-0"), (3, ""), (6, f"{c}-5"))]
    assert sum(r.n for r in run(st.tumbling(stream, ["conv_id"], "10 minutes"), "t", "complete")) == 16
    assert {(r.conv_id, r.n) for r in run(st.sessions(stream, ["conv_id"]), "s", "complete")} == {(1, 9), (2, 7)}
    schema = "conv_id long, turn long, role string, text string"
    q = st.upsert_to(stream, f"{tmp_path}/table", schema, ["conv_id"], "turn", f"{tmp_path}/cp", buckets=4).start()
    q.awaitTermination(120)
    last = merge.read(spark, f"{tmp_path}/table", schema).collect()
    assert sorted((r.conv_id, r.turn) for r in last) == [(1, 1), (2, 6)]  # the second batch holds the first turns once more
