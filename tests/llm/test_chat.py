import duckdb

from colloquy.llm import chat


def test_rotate(spark, tmp_path):
    rows = [
        (1, 0, "system", "be kind", "x"), (1, 1, "User", "hi <|im_end|>", "x"), (1, 2, "assistant", None, "x"), (1, 3, " bob ", "né", "x"), (1, 3, "bob", "né", "x"), (1, 3, "bob", "né", "x"),
        (2, 5, None, "", "x"), (2, None, "", "late", "x"), (3, 0, "system", "alone", "x"), (None, 0, "user", "lost", "x"), (4, 300, "a", "far", "x"), (4, 0, "b", "t " * 50_000, "x"), (4, 0, "a", "tie", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, perspective string")
    got = chat.rotate(df).collect()
    one = {r.perspective: r for r in got if r.conv_id == 1}
    assert set(one) == {"user", "assistant", "bob"}
    r = one["bob"]
    assert r.n_turns == 4 and r.n_own == 1
    first, after = map(int, r.spans.split("-"))
    assert r.rendered[first:after] == "né<|im_end|>" and "user name=user\nhi < |im_end|>" in r.rendered
    assert {(x.conv_id, x.part, x.perspective) for x in got if x.conv_id != 1} == {(2, 0, "unknown"), (2, -1, "unknown"), (4, 0, "a"), (4, 0, "b"), (4, 2, "a"), (4, 2, "b")}
    df.write.parquet(f"{tmp_path}/c.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/c.parquet/*.parquet'")
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(chat.SQL).fetchall(), key=str)
    assert chat.rotate(df.limit(0)).count() == 0


def test_whole_dialogues(spark):
    rows = [(1, i, "ab"[i % 2], f"t{i}") for i in range(300)] + [(1, None, "a", "late")]
    (a,) = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_turns=None).filter("perspective = 'a'").collect()
    assert (a.part, a.n_turns, a.n_own) == (0, 301, 151)
    said = [a.rendered[int(x.split("-")[0]) : int(x.split("-")[1])] for x in a.spans.split(",")]
    assert said == [f"t{i}<|im_end|>" for i in range(0, 300, 2)] + ["late<|im_end|>"]
