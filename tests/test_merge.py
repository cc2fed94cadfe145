import os

from colloquy.sources import merge

SCHEMA = "id long, a string, b long, log string"


def files(path):
    return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith(merge.BUCKET)}


def rows(spark, path):
    return sorted((tuple(r) for r in merge.read(spark, path, SCHEMA).collect()), key=str)


def test_columns_history_and_absence(spark, tmp_path):
    path = f"{tmp_path}/t"
    merge.create(spark.createDataFrame([(1, "x", 1, None), (2, "y", 2, "old"), (3, None, None, "")], SCHEMA), path, ["id"], 4)
    change = spark.createDataFrame([(1, 10, "one"), (2, None, "two"), (3, 30, None), (9, 90, "nine"), (None, 0, "lost")], "id int, b long, log string")
    for _ in range(2):  # brought in twice it counts once
        merge.merge(change, path, SCHEMA, ["id"], buckets=4, history=["log"])
        assert rows(spark, path) == [(1, "x", 10, "one"), (2, "y", None, "old; two"), (3, None, 30, ""), (9, None, 90, "nine")]
    merge.merge(spark.createDataFrame([(1, "z"), (50, "z")], "id long, a string"), path, SCHEMA, ["id"], buckets=4, insert=False)
    merge.merge(spark.createDataFrame([(2, "never"), (60, "new")], "id long, a string"), path, SCHEMA, ["id"], buckets=4, update=False)
    assert rows(spark, path) == [(1, "z", 10, "one"), (2, "y", None, "old; two"), (3, None, 30, ""), (60, "new", None, None), (9, None, 90, "nine")]
    several = spark.createDataFrame([(1, "first", 1), (1, "last", 3), (1, "middle", 2)], "id long, a string, at int")
    merge.merge(several, path, SCHEMA, ["id"], order="at", buckets=4)
    assert (1, "last", 10, "one") in rows(spark, path)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = f"{tmp_path}/t"
    merge.create(spark.range(2000).selectExpr("id", "'x' as a", "id as b", "'' as log"), path, ["id"], 32)
    before = files(path)
    assert merge.merge(spark.createDataFrame([(5, "changed"), (5_000_000, "new")], "id long, a string"), path, SCHEMA, ["id"], buckets=32) <= 2
    after = files(path)
    assert len(before) == 32 and sum(before[d] != after[d] for d in before) <= 2
    assert merge.merge(spark.createDataFrame([], "id long, a string"), path, SCHEMA, ["id"], buckets=32) == 0 and files(path) == after
    got = {r[0]: r[1] for r in rows(spark, path)}
    assert len(got) == 2001 and got[5] == "changed" and got[6] == "x" and got[5_000_000] == "new"
