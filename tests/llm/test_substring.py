import hashlib
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from colloquy.llm import substring
from colloquy.llm import textvec as tv

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    starts = {}
    for doc, text in rows:
        words = WORD.findall(text or "")
        if doc is not None:
            for i in range(len(words) - window + 1):
                key = tuple(words[i : i + window])
                starts[key] = min(starts.get(key, doc), doc)
    out = []
    for doc, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        if doc is not None:
            for i in range(len(words) - window + 1):
                if starts[tuple(words[i : i + window])] < doc:
                    gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_covers():
    for period, cover in substring.PERFECT.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    cover = substring.difference_cover(10)
    assert {(a - b) % 10 for a in cover for b in cover} == set(range(10))


def test_words_and_hashes():
    t = tv.Texts(pa.array(["a b  c", "", None, "\tc a b\x0b b c\n", "é"]))
    assert t.counts.tolist() == [3, 0, 0, 4, 1] and t.word(4) == "a b"
    p = tv.sequence_prefix(t.word_hashes())
    a, b = tv.sequences(p, np.array([1, 5]), 2)
    assert a == b


def test_deduplicate_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(500)]
    passage = [rng.choice(vocab) for _ in range(130)]
    rows = [(None, " ".join(passage)), (50, None), (51, ""), (52, "one two")]
    for i in range(40):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if i % 2:
            a = rng.randint(0, 60)
            words = words[: rng.randint(0, 40)] + passage[a : a + rng.randint(45, 75)] + words[40:]
        if i % 7 == 0:
            words += passage + passage
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(100 + i, rows[10][1]) for i in range(4)] + [rows[12], rows[12]] + [(rows[12][0], rows[13][1])]
    rows.append((200, " ".join(["same"] * 300)))
    rows.append((201, " ".join(["same"] * 120)))
    rows.append((202, " ".join(["same"] * 20_000)))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, tk string")
    for window in (50, 12):
        got = substring.deduplicate(docs, window).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(rows, window)
    assert substring.deduplicate(docs.limit(0)).count() == 0


def test_slices_cut_anew_in_every_evaluation_lose_nothing(spark, monkeypatch):
    """Rows come in any order and are cut anywhere, each time that a plan is run."""

    def slices(batches, column, most=0):
        rng = random.SystemRandom()
        for batch in batches:
            order = list(range(batch.num_rows))
            rng.shuffle(order)
            while order:
                n = rng.randint(1, 8)
                yield batch.take(pa.array(order[:n]))
                order = order[n:]

    monkeypatch.setattr(substring, "tv", SimpleNamespace(**{k: getattr(tv, k) for k in ("Texts", "as_long", "ragged", "sequences", "sequence_prefix")}, slices=slices))
    rng = random.Random(6)
    passages = [[f"p{rng.randint(0, 300)}" for _ in range(40)] for _ in range(10)]
    rows = [(i, " ".join([f"d{i}x{j}" for j in range(rng.randint(0, 9))] + rng.choice(passages) + rng.choice(passages) + [f"e{i}"])) for i in range(200)]
    got = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), 12).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(rows, 12)
