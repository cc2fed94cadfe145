import math
import random
from itertools import combinations

from colloquy.llm import decontam


def test_masks_survive_any_three_substitutions():
    for gone in combinations(range(15), 3):
        assert any(not any(s + k in gone for k in m) for m in decontam.MASKS for s in range(15 - m[-1]))


def test_short_items_keep_a_run():
    for n in range(decontam.LEAST_ITEM, 15):
        w, k = decontam.needed(n)
        for gone in combinations(range(w), w - k):
            runs = "".join("." if i in gone else "x" for i in range(w)).split(".")
            assert max(map(len, runs)) >= decontam.short_run(n)


def brute(text, items):
    words, out = (text or "").lower().split(), set()
    for item_id, item in items:
        it = (item or "").lower().split()
        if item_id is None or len(it) < 8:
            continue
        w = min(15, len(it))
        for shift in range(-len(it) + 1, len(words)):
            same = [0 <= shift + j < len(words) and words[shift + j] == it[j] for j in range(len(it))]
            if any(sum(same[a : a + w]) >= math.ceil(0.8 * w - 1e-9) for a in range(len(it) - w + 1)):
                out.add(item_id)
    return sorted(out)


def test_overlaps_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 8, 9, 10, 11, 12, 13, 14, 15, 22, 40])))) for i in range(40)] + [(None, "a b c d e f g h i j"), (70, None), (71, "")]
    items += [(72, items[9][1])]
    rows = [(900, None), (901, ""), (None, items[9][1])]
    for i in range(150):
        body = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        copy = items[rng.randrange(40)][1].split()
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = "zz"
        at = rng.randint(0, len(body))
        rows.append((i, " ".join(body[:at] + copy[rng.randint(0, 3) :] + body[at:]).upper()))
    rows += [rows[5], rows[5], (5000, "w1 " * 30_000)]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, found string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, brute(t, items)) for i, t in rows), key=str)
    for block in (10_000, 200):
        got = decontam.overlaps(docs, bench, block_words=block).collect()
        assert sorted(((r.doc_id, sorted({x.item_id for x in r.found})) for r in got), key=str) == want
        kept = decontam.keep_clean(docs, bench, block_words=block)
        assert kept.schema == docs.schema and kept.count() == sum(not x for _, x in want)
    assert decontam.overlaps(docs.limit(0), bench).count() == 0
    assert decontam.overlaps(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_items_without_an_id_count(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "so " + item), (2, "so one two")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (None, "another " + item), (None, None), (7, item)], "item_id long, text string")
    for block in (10_000, 10):
        got = {r.doc_id: (r.contaminated, {x.item_id for x in r.found}) for r in decontam.overlaps(docs, bench, block_words=block).collect()}
        assert got == {1: (True, {None, 7}), 2: (False, set())}
        assert [r.doc_id for r in decontam.keep_clean(docs, bench.filter("item_id is null"), block_words=block).collect()] == [2]


def test_short_items_word_for_word(spark):
    items = [(1, "alpha beta gamma"), (2, "one two three four five six seven"), (3, "yes"), (4, "yes sir"), (5, "a b c d e f g h")]
    rows = [(1, "so Alpha  beta\tgamma it is"), (2, "alpha beta delta gamma"), (3, "zero one two three four five six seven"), (4, "one two three four five six eight"), (5, "yes sir"), (6, "a b c d e f z h"), (7, "beta gamma")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, d int, T_ int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1000, 8):
        got = {r.doc_id: [x.item_id for x in r.found] for r in decontam.overlaps(docs, bench, block_words=block, least_item=decontam.LEAST_VERBATIM).collect()}
        assert got == {1: [1], 2: [], 3: [2], 4: [], 5: [], 6: [5], 7: []}
        kept = decontam.keep_clean(docs, bench, block_words=block, least_item=decontam.LEAST_VERBATIM)
        assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 7]


def test_items_of_one_and_two_words(spark):
    items = [(1, "wikipedia.org"), (2, "yes sir"), (3, "see"), (4, ""), (5, None)]
    rows = [(1, "from Wikipedia.org, see"), (2, "WIKIPEDIA.ORG"), (3, "yes  sir see"), (4, "yes, sir"), (5, ""), (6, None), (7, "see see see")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1000, 1):
        got = {r.doc_id: [x.item_id for x in r.found] for r in decontam.overlaps(docs, bench, block_words=block, least_item=1).select("doc_id", decontam.F.array_sort(decontam.F.array_distinct(decontam.F.transform("found", lambda x: decontam.F.struct(x["item_id"].alias("item_id"))))).alias("found")).collect()}
        assert got == {1: [3], 2: [1], 3: [2, 3], 4: [], 5: [], 6: [], 7: [3]}


def test_common_seeds_in_portions(spark, monkeypatch):
    """Items that share their words meet a text that repeats them, a few pairs at a time."""
    monkeypatch.setattr(decontam, "PAIRS", 7)
    words = "a b c d e f g h i j k l m n o".split()
    items = [(i, " ".join([*words, f"x{i}"])) for i in range(30)]
    seeds = decontam.Seeds([t for _, t in items])
    import pyarrow as pa

    from colloquy.llm import textvec as tv

    text, item, shift = seeds.hits(tv.Texts(pa.array([" ".join(words * 3), "z z", " ".join(words)]), fold=True))
    assert sorted(zip(text.tolist(), item.tolist(), shift.tolist())) == sorted([(0, i, s) for i in range(30) for s in (0, 15, 30)] + [(2, i, 0) for i in range(30)])
