import pytest

from colloquy.functions import replies
from colloquy.operators import agent
from colloquy.operators import turns as turn_ops


def told(call):
    return call and (call.tool, call.text or call.ids, call.turns)


@pytest.mark.parametrize("response,want", [
    ("thinking\nGREP: cat", ("GREP", "cat", None)), ("**FINAL** s1:2, s2:3", ("FINAL", ["s1:2", "s2:3"], None)), ("no command", None), (None, None), ("grep is a tool\nthat reads", None), ("grep: cat", ("GREP", "cat", None)),
    ("GREP: (cat|dog)", ("GREP", "(cat|dog)", None)), ("GREP(cat)", ("GREP", "cat", None)), ("GREP: cat\nREAD", ("GREP", "cat", None)), ("READ: s1:4:u 3", ("READ", ["s1:4:u"], 3)), ("READ s1:4 99", ("READ", ["s1:4"], None)), ('GREP "two words"', ("GREP", "two words", None)),
    ("FINAL:", ("FINAL", [], None)), ("FINAL: s3, s2", ("FINAL", ["s3", "s2"], None)), ("GREP: don't it's", ("GREP", "don't it's", None)), ("GREP: ^a.*b$", ("GREP", "^a.*b$", None)),
    ('<|channel|>commentary to=tools.GREP <|constrain|>json<|message|>{"pattern": "a.b"}', ("GREP", "a.b", None)), ('to=GREP<|message|>{"p": "x"}<|call|>', ("GREP", "x", None)),
    ('to=READ <|message|>{"sid": "s1:4:u", "k": 3}', ("READ", ["s1:4:u"], 3)), ('to=READ<|message|>{"sid": "s1:4:u"}', ("READ", ["s1:4:u"], None)), ('to=READ<|message|>{"k": 3}', None),
    ('to=GREP <|message|>{"cmd": ["VECTOR", "blue car"]}', ("VECTOR", "blue car", None)), ('to=FINAL<|message|>{"sids": ["s1:1", "x", "s2:2"]}', ("FINAL", ["s1:1", "s2:2"], None)),
    ('to=GREP <|constrain|>="two words"', ("GREP", "two words", None)), ('to=GREP <|message|>{"a": "first"} then to=VECTOR <|message|>{"a": "second"}', ("VECTOR", "second", None)), ("to=GREP<|message|>blue car\nand more", ("GREP", "blue car", None)),
    ('{"name": "functions.read", "arguments": "s1:1"}', ("READ", ["s1:1"], None)), ('so {"name": "GREP", "arguments": {"pattern": "x y"}}', ("GREP", "x y", None)), ('{"name": "GREP", "arguments": "{\\"p\\": \\"q\\"}"}', ("GREP", "q", None)), ('{"name": 3}', None), ("{broken", None),
])
def test_calls(response, want):
    assert told(replies.call_of(response)) == want


@pytest.mark.parametrize("prose,want", [
    ("I should use READ on s1:6:u.", ("READ", ["s1:6:u"], None)), ('Use GREP for "Music and Medicine".', ("GREP", "Music and Medicine", None)), ('"far" is far away, so "near": VECTOR', ("VECTOR", "near", None)),
    ("First GREP marathon, then FINAL", ("FINAL", [], None)), ("First GREP marathon, then READ", None), ("Search for cats", None), ("s1:1 looks good. FINAL: s1:1 and s2:2", ("FINAL", ["s1:1", "s2:2"], None)), (None, None),
])
def test_narrated_calls(prose, want):
    assert told(replies.narrated(prose)) == want


TURNS = ["a red cat", "a dog", "cat two", "blue car", "the end"]


def check(spark, cases, **more):
    """cases: commands (or commands and reasoning), seeds, what is kept. Each is a question with turns of its own; all run at once."""
    corpus = spark.createDataFrame([(q, f"s1:{i}", i, t) for q in range(len(cases)) for i, t in enumerate(TURNS)], "question int, sid string, pos int, text string")
    script = spark.createDataFrame([(q, n, *(c if isinstance(c, tuple) else (c, None))) for q, (commands, _, _) in enumerate(cases) for n, c in enumerate(commands)], "question int, step int, command string, reasoning string")
    seeds = spark.createDataFrame([(q, f"s1:{s}") for q, (_, own, _) in enumerate(cases) for s in own], "question int, sid string")
    got = {}
    for r in agent.refine(seeds, corpus, script, **more).collect():
        got.setdefault(r.question, set()).add((int(r.sid[-1]), r.origin))
    for q, (commands, _, want) in enumerate(cases):
        assert got.get(q, set()) == want, commands


def test_tools_and_ends(spark):
    check(spark, [
        (["VECTOR: blue car", "FINAL: s1:3 s1:2"], [2], {(3, "found"), (2, "seed")}),
        (["READ: s1:1 1", "FINAL: s1:0 s1:4"], [2], {(0, "found"), (4, "named")}),
        (["READ: 10:30, s1:4", "FINAL: s1:1 s1:3"], [2], {(1, "named"), (3, "found")}),
        (["GREP: cat", "GREP: cat", "FINAL: s1:0"], [2], {(2, "seed")}),
        (["x", "y", "z", "FINAL: s1:0"], [2], {(2, "seed")}),
        (["x", "y", "GREP: a", "x", "y", "FINAL: s1:0"], [2], {(0, "found")}),
        ([("hm", "so FINAL s1:4")], [2], {(4, "named")}),
        (["GREP: (cat", "FINAL: s1:0 s1:2"], [2], {(0, "named"), (2, "seed")}),  # no regular expression: literal
        (["GREP: red the cat", "GREP: two, cat", "FINAL: s1:0 s1:2"], [4], {(0, "named"), (2, "found")}),  # all words, in any order
        (["FINAL: s1:0 s1:2"], [2], {(0, "named"), (2, "seed")}),
        (["FINAL: nothing:9"], [2], {(2, "seed")}),
        (["FINAL: s1:4"], [], {(4, "named")}),
        ([], [1, 3], {(1, "seed"), (3, "seed")}),
    ])


def test_limits(spark):
    check(spark, [
        (["GREP: cat", "GREP: dog", "FINAL: s1:0"], [2], {(0, "found")}),  # the reply after the last call is a FINAL
        (["GREP: cat", "GREP: dog", "GREP: two", "FINAL: s1:0"], [2], {(2, "seed")}),
        (["x", "y", "z"], [2], {(2, "seed")}),
        (["GREP: a", "FINAL: s1:3 s1:0"], [2], {(0, "found"), (3, "named")}),
        (["FINAL: s1:4 s1:1 s1:2"], [2], {(4, "named"), (1, "named")}),
    ], calls=2, cap=2, lines=1)


@pytest.mark.parametrize("mode,want", [("filter", [{(2, "seed")}, {(2, "seed")}]), ("fetch_only", [{(0, "named"), (2, "seed")}, {(0, "named"), (2, "seed")}])])
def test_modes(spark, mode, want):
    check(spark, [(["FINAL: s1:0 s1:2"], [2], want[0]), (["FINAL: s1:0"], [2], want[1])], mode=mode)


def test_questions_keep_apart(spark):
    """Hits, ids and ends of one question are no other's; a question without a script or without turns keeps its seeds."""
    corpus = spark.createDataFrame([(q, f"s{q}:{i}", i, "cat" if i == q else "dog", "2023-0" + str(i)) for q in (1, 2) for i in range(3)], "question int, sid string, pos int, text string, date string")
    seeds = spark.createDataFrame([(1, "s1:0"), (2, "s2:0"), (3, "s3:9"), (1, "s1:0")], "question int, sid string")
    script = spark.createDataFrame([(1, 1, "GREP: cat"), (1, 2, "FINAL: s1:1 s2:2 1:2"), (2, 1, "GREP: 2023-01"), (2, 2, "FINAL: s2:1 s2:2")], "question int, step int, command string")
    got = sorted(map(tuple, agent.refine(seeds, corpus, script).collect()))
    assert got == [(1, "s1:1", "found"), (1, "s1:2", "named"), (2, "s2:1", "found"), (2, "s2:2", "named"), (3, "s3:9", "seed")]
    assert sorted(map(tuple, agent.refine(seeds, corpus, script.limit(0)).collect())) == [(1, "s1:0", "seed"), (2, "s2:0", "seed"), (3, "s3:9", "seed")]


def test_resolution_by_the_end_of_a_session(spark):
    known = spark.createDataFrame([(1, s) for s in ("answer_55:1:u", "answer_55:1:a", "other:2", "xx7:3", "yy7:3", "c:0t1", "c:0t2")] + [(2, "yy7:3")], "q int, sid string")
    asked = spark.createDataFrame([(1, r) for r in ("answer_55:1:u", " 55:1", "55:1:a", "7:3", "r:2", "nothing:1", "c:0", "55", ":1", "", None)] + [(2, "7:3")], "q int, raw string")
    got = sorted((r.q, r.raw, r.sid, r.step) for r in turn_ops.resolved(asked, known, ["q"]).collect())
    assert got == [(1, " 55:1", "answer_55:1:a", 12), (1, " 55:1", "answer_55:1:u", 12), (1, "55:1:a", "answer_55:1:a", 11), (1, "answer_55:1:u", "answer_55:1:u", 1), (1, "c:0", "c:0t1", 3), (1, "c:0", "c:0t2", 3), (1, "r:2", "other:2", 11), (2, "7:3", "yy7:3", 11)]


def test_recovery_and_replay(spark):
    kept = spark.createDataFrame([(1, "a", "seed"), (2, "x", "seed")], "question int, sid string, origin string")
    seeds = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "d"), (3, "z")], "question int, sid string")
    verdicts = spark.createDataFrame([(1, "b", "KEEP: yes"), (1, "c", "drop"), (1, "d", " keep"), (3, "z", "KEEP")], "question int, sid string, verdict string")
    got = agent.recovered(kept, seeds, verdicts, 2).collect()
    assert sorted(map(tuple, got)) == [(1, "a", "seed"), (1, "b", "recovered"), (2, "x", "seed"), (3, "z", "recovered")]
    contexts = spark.createDataFrame([(1, "old one"), (9, "old nine")], "question int, context string")
    texts = spark.createDataFrame([("a", "text a", 1), ("x", "text x", 2)], "sid string, text string, pos int")
    assert sorted(map(tuple, agent.replayed(contexts, kept, texts).collect())) == [(1, "text a", True), (9, "old nine", False)]
    assert {r.refined for r in agent.replayed(contexts, kept, texts, enabled=False).collect()} == {False}
