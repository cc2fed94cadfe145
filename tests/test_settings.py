import pytest

from colloquy import settings as st
from colloquy.functions import jsons


def test_settings_are_checked():
    assert st.Search().entity_topk == 20 and st.Agent(categories=("a",)).applies_to("a") and not st.Agent(categories=()).applies_to("a") and st.Agent().applies_to(None)
    for bad in (lambda: st.Search(entity_topk=0), lambda: st.Search(keyword_mode="x"), lambda: st.Ingest(mode="z"), lambda: st.Ingest(mode="chunk"), lambda: st.Agent(mode="q"), lambda: st.Activation(cut=1.0)):
        with pytest.raises(ValueError):
            bad()


def test_switches_and_settings_without_effect():
    assert st.switched_on("NO_RERANK", {"NO_RERANK": "1"}) and not st.switched_on("NO_RERANK", {"NO_RERANK": "false"})
    assert "dense" not in st.channels({"NO_DENSE": "yes"}) and len(st.channels({})) == 7
    assert st.without_effect(st.Evidence(rerank=False, rerank_topk=5), {}) == ["rerank_topk"] and st.without_effect(st.Evidence(rerank=False), {}) == []
    assert st.without_effect(st.Evidence(direct_least=0.1), {"NO_DIRECT": "1"}) == ["direct_least"]
    with pytest.raises(ValueError):
        st.switched_on("NO_SUCH", {})


def test_sweeps():
    got = st.sweep(st.Search(), {"wide": {"entity_topk": 50}, "same": {}})
    assert got["wide"].entity_topk == 50 and got["same"] == st.Search()
    with pytest.raises(ValueError):
        st.sweep(st.Search(), {"x": {"nothing": 1}})


def test_throttle_and_retries():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    t = st.Throttle(2, 60, lambda: now[0], sleep)
    for _ in range(5):
        t.wait()
    assert slept == [60, 60]
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 4:
            raise OSError("busy")
        return "ok"

    waits = []
    assert st.retried(call, sleep=waits.append) == "ok" and waits == [2, 4, 8]
    with pytest.raises(OSError):
        st.retried(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=waits.append)


def test_leaves_level_by_level(spark):
    assert jsons.leaves({"a": ["x", {"b": "deep", "n": 2}], "c": "y", "t": True, "f": 1.5, "m": 3}) == (["y", "x", "deep"], [3, 2])
    df = spark.createDataFrame([('{"b": 1, "a": [2, "x"]}', " 2.5 "), ("no json", ""), (None, None)], "j string, n string")
    got = df.select(jsons.flattened("j").alias("l"), jsons.compact(df.j).alias("c"), jsons.number(df.n).alias("n"), jsons.dotted(df.j, "b").alias("d")).collect()
    assert [(r.l.strings, r.l.ints, r.c, r.n, r.d) for r in got] == [(["x"], [1, 2], '{"a":[2,"x"],"b":1}', 2.5, 1.0), ([], [], None, None, None), ([], [], None, None, None)]
