import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import hmm
from colloquy.llm import textvec as tv

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small(seed=0, states=3, classes=5):
    rng = np.random.default_rng(seed)
    start, move, emit = rng.uniform(size=states), rng.uniform(size=(states, states)), rng.uniform(size=(classes, states))
    return hmm.Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def paths(m, seq):
    for path in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= m.move[path[t - 1], path[t]] * m.emit[seq[t], path[t]]
        yield path, p


def test_forward_is_exact():
    m = small()
    seqs = [[0, 1, 4], [2], [3, 3, 1, 0, 2]]
    flat, bounds = np.array(sum(seqs, [])), np.array([0, 3, 4, 9])
    for s, got in zip(seqs, hmm.log_likelihood(m, flat, bounds), strict=True):
        assert got == pytest.approx(math.log10(sum(p for _, p in paths(m, s))))


def test_expected_counts():
    m = small(1)
    seqs = [[0, 1, 4, 2], [3, 3]]
    starts, moves, emissions, log = hmm.expected(m, np.array(sum(seqs, [])), np.array([0, 4, 6]), np.array([True, True]))
    want = [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))]
    total = 0.0
    for s in seqs:
        z = sum(p for _, p in paths(m, s))
        total += math.log(z)
        for path, p in paths(m, s):
            want[0][path[0]] += p / z
            for t, (c, k) in enumerate(zip(s, path, strict=True)):
                want[2][c, k] += p / z
                if t:
                    want[1][path[t - 1], k] += p / z
    for a, b in zip((starts, moves, emissions), want, strict=True):
        assert np.allclose(a, b, atol=1e-5)
    assert log == pytest.approx(total, rel=1e-5)


def test_stretches():
    cut, first = hmm.stretches(np.zeros(600, int), np.array([0, 10, 600]))
    assert cut.tolist() == [0, 10, 266, 522, 600] and first.tolist() == [True, True, False, False]


def test_score(spark):
    rng = random.Random(3)
    langs = [["".join(rng.choice(a) for _ in range(rng.randint(1, 4))) + e for _ in range(60)] for a, e in (("abcd", "x"), ("abcd", "y"), ("efgh", "ü"))]
    rows = [(i, " ".join(rng.choice(rng.choices([w[:12], w])[0]) for _ in range(rng.randint(1, 60)))) for i in range(300) for w in [langs[i % 3]]]
    rows += [(500, None), (501, ""), (502, "Never SEEN words"), (503, "a " * 3000), (None, "no id"), rows[4], rows[4]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rid int")
    got = hmm.score(docs, states=4, rounds=2, head_words=40, words=15).collect()
    assert len(got) == len(rows)
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    held = {i: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter()
    for i, t in rows:
        if not held[i]:
            c.update(WORD.findall(lower(t)) + ["\n"])
    n, v = sum(c.values()), len(c)
    texts = dict(rows)
    better = []
    for r in got:
        toks = WORD.findall(lower(texts[r.doc_id])) + ["\n"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(toks), sum(c[t] > 0 for t in toks), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in toks), rel=1e-9)
        assert r.score < 0
        if r.held_out and r.doc_id is not None and r.doc_id < 300:
            better.append((r.score, r.base_score))
    assert sum(s for s, _ in better) > sum(b for _, b in better) + 0.1 * len(better)
    assert hmm.score(docs.limit(0)).count() == 0


def test_every_round_covers_all_training_texts(spark):
    """Scores equal those of rounds over all texts in one place, beyond any sample of texts and with a long one."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcd" if i % 40 else "efgh") for _ in range(rng.randint(1, 6)))) for i in range(4000)]
    rows.append((4001, " ".join(rng.choice("aei") for _ in range(25_000))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in hmm.score(docs, states=3, rounds=1, warm_rounds=5).collect()}
    at = {w: 1 + i for i, w in enumerate("abcdefghi")}
    assert zlib.crc32(b"4001") % 10
    training = [[at[w] for w in t.split()] + [0] for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    # classes of the common words are in the order of their counts
    voc = hmm.vocabulary(hmm.count_words(spark.createDataFrame([(t,) for i, t in rows if zlib.crc32(str(i).encode()) % 10], "text string")), len(training))
    h = tv.Texts(pa.array([" ".join(at)])).word_hashes()
    cls = voc.look_up(h, np.zeros(len(h), np.int64))[0]
    to = np.concatenate(([0], cls))
    flat = lambda seqs: (to[np.concatenate(seqs)], np.concatenate(([0], np.cumsum([len(s) for s in seqs]))))
    seq, bounds = flat(training)
    cut, first = hmm.stretches(seq, bounds)
    model = hmm.initial(voc.unigram, 3)
    for _ in range(6):
        starts, moves, emissions, _ = hmm.expected(model, seq, cut, first)
        model = hmm.improved(starts, moves, emissions, voc.unigram)
    want = hmm.log_likelihood(model, *flat([[at[w] for w in t.split()] + [0] for _, t in rows]))
    assert [got[i] for i, _ in rows] == pytest.approx(want.tolist(), rel=1e-4)


def test_probabilities_of_words_sum_to_one(spark):
    """Known words of every class and one unseen word for each class of endings take all the mass."""
    words = [f"w{i % 37}{'abc'[i % 3]}" for i in range(400)]
    counts = hmm.count_words(spark.createDataFrame([(" ".join(words),)], "text string"))
    voc = hmm.vocabulary(counts, 1)
    assert voc.n == 401 and voc.v == len(set(words)) + 1 and voc.unigram.sum() == pytest.approx(1)
    c = Counter(words)
    own = {int(h): k for h, k in zip(voc.keys, voc.classes, strict=True)}
    assert len(own) == len(c) and all(k <= hmm.WORDS for k in own.values())
    assert np.allclose(voc.base, 0.1)
    few = hmm.vocabulary(counts, 1, 40, 5)
    classes = dict(zip(few.keys.tolist(), few.classes.tolist(), strict=True))
    table = {r.h: (r.ending, r.c) for r in counts.collect()}
    mass = np.zeros(hmm.ENDINGS)
    for h, (end, n) in table.items():
        if classes.get(h % 2**64, 1 << 30) > 5:
            mass[end] += n + 0.1
    assert np.allclose(mass + 0.1, few.base)
