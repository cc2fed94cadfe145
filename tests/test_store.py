import pytest

from colloquy.sources import store


def test_versions_swap_and_roll_back(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    assert s.is_cold("t")
    s.publish("t", df, dims=3)
    assert not s.is_cold("t") and s.current("t")["rows"] == 3 and s.current("t")["settings"] == {"dims": 3}
    with pytest.raises(ValueError, match="not valid"):
        s.publish("t", df.limit(1), valid=lambda d: d.count() == 3)
    assert s.read("t").count() == 3 and len(s.files.names(str(tmp_path / "s/t/data"))) == 1
    s.update("t", spark.createDataFrame([(2, "new"), (9, "no")], df.schema), "id")
    s.delete("t", spark.createDataFrame([(1,)], "id int"), "id")
    assert sorted(map(tuple, s.read("t").collect())) == [(2, "new"), (3, "c")]
    s.rollback("t")
    assert sorted(map(tuple, s.read("t").collect())) == [(1, "a"), (2, "new"), (3, "c")]
    s.clear("t")
    assert s.read("t").count() == 0 and s.read("t").schema == df.schema
    s.vacuum("t")
    assert len(s.files.names(str(tmp_path / "s/t/data"))) == 2
    with pytest.raises(FileNotFoundError):
        s.read("none")


def test_snapshots(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.publish("nodes", spark.createDataFrame([("a",), ("b",)], "id string"))
    s.publish("edges", spark.createDataFrame([("a", "b")], "src string, dst string"))
    at = str(tmp_path / "snap" / "1")
    s.snapshot(at, ["nodes", "edges"], model="m1")
    with pytest.raises(FileExistsError):
        s.snapshot(at, ["nodes"])
    s.clear("nodes")
    with pytest.raises(ValueError, match="other settings"):
        s.restore(at, model="m2")
    assert s.restore(at, model="m1") == ["edges", "nodes"] and s.read("nodes").count() == 2
    for f in (tmp_path / "snap" / "1" / "edges").glob("*.parquet"):
        f.unlink()
    with pytest.raises(ValueError, match="does not match"):
        s.restore(at, model="m1")
    with pytest.raises(ValueError, match="whole"):
        s.restore(str(tmp_path / "none"))


def test_changed_data_is_seen(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.publish("t", spark.createDataFrame([(1,), (2,)], "id int"))
    s.verify("t")
    spark.createDataFrame([(3,)], "id int").write.mode("append").parquet(f"{tmp_path}/s/t/data/{s.current('t')['version']}")
    with pytest.raises(ValueError, match="does not match"):
        s.verify("t")
