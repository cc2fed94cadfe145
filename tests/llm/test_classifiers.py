import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from colloquy.llm import labelled, quality, toxicity
from colloquy.llm import textvec as tv


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    for v in set(scores):
        m = np.array(scores) == v
        rank[m] = rank[m].mean()
    y = np.array(labels) == 1
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def world(spark, junk):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    docs, labels = [], []
    for i in range(700):
        sents = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(2, 25))]
        bad = rng.random() < 0.3
        if bad:
            junk(sents, rng)
        docs.append((i, ". ".join(sents) + ".", "en"))
        if i % 5:
            labels.append((i, int(not bad), int(bad)))
    docs += [(9000, "", "en"), (9001, None, "en"), (None, "no id here", "en"), (5, docs[5][1], "en"), (9002, "x" * 300_000, "en"), (9003, "... ---", "en")]
    labels += [(9100, 1, 0), (None, 1, 1), (4, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {d: (q, t) for d, q, t in labels}


def test_bucket(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, 123456, -5)], "doc_id long")
    for r in df.select("doc_id", labelled.bucket(df.doc_id, 5).alias("b")).collect():
        assert r.b == zlib.crc32(str(r.doc_id).encode()) % 5


def test_toxicity_on_held_out(spark):
    docs, labels, truth = world(spark, lambda s, rng: s.insert(rng.randrange(len(s)), f"you zorgl{rng.choice(['s', 'ish', 'en', 'a'])}"))
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    test = [r for r in got if r.doc_id in truth and truth[r.doc_id][1] is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(test) > 50 and auc([r.score for r in test], [truth[r.doc_id][1] for r in test]) > 0.97
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = [texts[r.doc_id].encode()[x.start : x.stop].decode() for r in got for x in r.offending if r.doc_id in truth]
    assert found and sum("zorgl" in x for x in found) > 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in got) and all(r.score == 0 for r in got if r.doc_id in (9000, 9001, 9003))
    kept = toxicity.keep_clean(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    one = toxicity.fit([(b"\0\0\0\0", 0)], np.zeros(0, np.int32), np.zeros(0))
    assert toxicity.train(docs, labels.limit(0)).score(toxicity.Sentences(pa.array(["a b"])))[0] < 0.5
    assert toxicity.score(docs.limit(3), one).count() == 3


def test_quality_on_held_out(spark):
    docs, labels, truth = world(spark, lambda s, rng: s.extend([" ".join(["| ab"] * 20)] if rng.random() < 0.5 else ["dup " * 40]))
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.doc_id in truth and truth[r.doc_id][0] is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(test) > 80 and auc([r.score for r in test], [truth[r.doc_id][0] for r in test]) > 0.95
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.score(docs.limit(3), quality.fit([])).count() == 3


def test_quality_by_words_alone(spark):
    """Texts that look alike and differ in which words they use."""
    rng = random.Random(8)
    kinds = [["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(150)] for _ in range(2)]
    rows = [(i, " ".join(rng.choice(kinds[i % 2] if rng.random() < 0.4 else kinds[0] + kinds[1]) for _ in range(80)), i % 2) for i in range(800)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    test = [r for r in quality.score(docs, quality.train(docs, labels)).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(test) > 200 and sum(r.predicted == r.doc_id % 2 for r in test) > 0.95 * len(test)


def test_gradients_of_attention():
    rng = np.random.default_rng(1)
    model = quality.Model(np.zeros(quality.SURFACE), np.ones(quality.SURFACE))
    model.p["Ww"] += rng.normal(0, 0.3, model.p["Ww"].shape)
    bounds, y = np.array([0, 3, 4, 12]), np.array([1.0, 0, 1])
    size = rng.integers(1, 9, 12).astype(np.uint8)
    x = (rng.normal(size=(12, quality.SURFACE)), rng.choice([5, 9, 4095, 5 + quality.BINS, 4095 + quality.BINS], int(size.sum())).astype(np.uint16), size)

    def loss():
        s = model.forward(*x, bounds)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grads = model.gradients(model.forward(*x, bounds), y)
    for k, g in grads.items():
        v = model.p[k].reshape(-1)
        for i in rng.integers(v.size, size=4) if k != "Ww" else [5 * quality.HIDDEN, 9 * quality.HIDDEN + 3, 4095 * quality.HIDDEN + 7, 8]:
            keep = v[i]
            v[i] = keep + 1e-6
            up = loss()
            v[i] = keep - 1e-6
            down = loss()
            v[i] = keep
            assert abs((up - down) / 2e-6 - g.reshape(-1)[i]) < 1e-6


def test_sentence_bounds():
    s = toxicity.Sentences(pa.array(["One two. Three! four", "", None, "five\nsix"]))
    assert s.bounds.tolist() == [0, 3, 3, 3, 5]


def plain_features(words):
    """The surface of one passage, and the bin and sign of each word, by loops."""
    n, out = len(words), []
    body = " ".join(words).encode()
    for c in quality.CLASSES:
        out.append(sum(int(c[b]) for b in body) / len(body))
    out.append(len(set(words)) / n)
    out.append(sum(a == b for a, b in zip(words, words[1:])) / n)
    out.append(sum(a == b for a, b in zip(words, words[2:])) / n)
    sizes = [len(w.encode()) for w in words]
    out += [sum(sizes) / n / 10, sum(x == 1 for x in sizes) / n, sum(x > 20 for x in sizes) / n, (sum((x - sum(sizes) / n) ** 2 for x in sizes) / n) ** 0.5 / 10, math.log1p(n) / 5]
    hashes = [int(tv.Texts(pa.array([w])).word_hashes()[0]) for w in words]
    return out, [(h >> 52, 2 * (h >> 51 & 1) - 1) for h in hashes]


def test_attention_against_plain_loops(spark):
    rng = random.Random(5)
    model = quality.Model(np.zeros(quality.SURFACE), np.ones(quality.SURFACE))
    p = model.p
    p["Ww"] += np.random.default_rng(3).normal(0, 0.5, p["Ww"].shape)
    texts = [" ".join(rng.choice(["a", "bb", "Ccc", "d1", "e!", "ü", "x" * 25]) for _ in range(n)) for n in (1, 63, 64, 65, 200)] + ["", None]
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        words = (text or "").split()
        encoded, weight = [], []
        for a in range(0, len(words), 64):
            x, bins = plain_features(words[a : a + 64])
            said = [sum(sign * p["Ww"][b, j] for b, sign in bins) / math.sqrt(len(bins)) for j in range(quality.HIDDEN)]
            h = [math.tanh(sum(v * p["We"][k, j] for k, v in enumerate(x)) + said[j] + p["be"][j]) for j in range(quality.HIDDEN)]
            e = 0.0
            for j in range(quality.GATE):
                t, u = (sum(h[k] * p[m][k, j] for k in range(quality.HIDDEN)) for m in ("V", "U"))
                e += math.tanh(t) / (1 + math.exp(-u)) * p["a"][j]
            encoded.append(h)
            weight.append(math.exp(e))
        z = [sum(w * h[j] for w, h in zip(weight, encoded)) / sum(weight) if weight else 0.0 for j in range(quality.HIDDEN)]
        want = 1 / (1 + math.exp(-sum(z[j] * p["w"][j] for j in range(quality.HIDDEN)) - p["b"][0]))
        assert abs(got[i].score - want) < 1e-5
        assert got[i].passage == (64 * weight.index(max(weight)) if weight else None)


def test_noisy_or_against_plain_loops(spark):
    rng = random.Random(6)
    weights = np.array([rng.gauss(0, 1) for _ in range(1 << 10)] * (toxicity.BINS >> 10), np.float32)
    model = toxicity.Model(weights, -1.5)
    texts = ["One two. three! four?\nfive SIX seven", "alone", "", None, "... ---", "a-b c'd 12 e. f", "über. Größe ü! ÿ", "w " * 300]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        quiet, offending = 1.0, []
        for m in re.finditer(r"[^.!?\n]+", text or ""):
            words = re.findall(r"[A-Za-z\x80-\U0010ffff]+", m[0])
            if not words:
                continue
            z = -1.5
            for w in words:
                raw = re.sub(rb"[A-Z]", lambda x: x[0].lower(), w.encode())
                for n, salt in ((4, 4), (6, 6), (len(raw), 0)):
                    z += weights[int(plain_hash(raw[:n], salt)) & (toxicity.BINS - 1)]
            one = 1 / (1 + math.exp(-z))
            quiet *= 1 - one
            if one >= 0.5:
                offending.append(one)
        assert abs(got[i].score - (1 - quiet)) < 1e-6
        assert [round(x.score, 4) for x in got[i].offending] == [round(x, 4) for x in offending]


def plain_hash(raw, salt):
    """Polynomial of the bytes' values, by Python's integers."""
    total, power = 0, 1
    for b in raw:
        total += int(tv._BYTE[b]) * power
        power = power * tv._R % 2**64
    return tv.mix(np.array([total % 2**64], np.uint64), salt)[0]
