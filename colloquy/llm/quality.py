"""Quality by attention-based multiple-instance learning.

A text is a bag of passages. Each is encoded by a learned vector for each of its words (4,096 signed bins of word hashes), and by
what its words and bytes look like; a gated attention weighs the passages, and the weighted sum is classified; all weights are learned
together from labels of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import cluster, labelled
from colloquy.llm import textvec as tv

PASSAGE = 64
HIDDEN, GATE = 16, 8


def _byte_class(chars) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


CLASSES = [
    _byte_class(range(65, 91)),  # capitals
    _byte_class(range(97, 123)),  # small letters
    _byte_class(range(48, 58)),  # digits
    _byte_class(range(128, 256)),  # bytes of other letters
    _byte_class(map(ord, ".,;:'\"()-")),  # usual punctuation
    _byte_class(map(ord, "!?")),
    _byte_class([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-!?"]),  # symbols
    _byte_class([10]),
]
SURFACE = len(CLASSES) + 8
#: Signed bins of the words' hashes, as a power of two.
WORD_BITS = 12
BINS = 1 << WORD_BITS


class Passages:
    """Consecutive runs of up to PASSAGE words of each text of a slice: what they look like (surface), how many words they have (size), and each word's bin, with its sign one bit higher (words)."""

    def __init__(self, column: pa.Array):
        t = self.texts = tv.Texts(column)
        per = (t.counts + PASSAGE - 1) // PASSAGE
        self.bounds = np.concatenate(([0], np.cumsum(per)))
        k = np.arange(self.bounds[-1]) - np.repeat(self.bounds[:-1], per)
        first = np.repeat(t.bounds[:-1], per) + k * PASSAGE
        last = np.minimum(first + PASSAGE, np.repeat(t.bounds[1:], per))
        n = np.maximum(last - first, 1).astype(np.float64)
        x = self.surface = np.zeros((len(first), SURFACE), np.float32)
        self.size, self.words = (last - first).astype(np.uint8), np.zeros(0, np.uint16)
        if not len(first):
            return
        a, b = t.start[first], t.end[last - 1]
        size = np.maximum(b - a, 1).astype(np.float64)
        for i, c in enumerate(CLASSES):
            total = np.concatenate(([0], np.cumsum(c[t.data])))
            x[:, i] = (total[b] - total[a]) / size
        h, of = t.word_hashes(), np.repeat(np.arange(len(first)), last - first)
        order = np.lexsort((h, of))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
        length = (t.end - t.start).astype(np.float64)
        inside = of[1:] == of[:-1]
        again = np.concatenate(([False], (h[1:] == h[:-1]) & inside))
        second = np.zeros(len(h), bool)
        second[2:] = (h[2:] == h[:-2]) & (of[2:] == of[:-2])

        def mean(values: np.ndarray) -> np.ndarray:
            return np.bincount(of, values, len(first)) / n

        m = len(CLASSES)
        x[:, m] = np.bincount(of[order], new, len(first)) / n  # share of distinct words
        x[:, m + 1], x[:, m + 2] = mean(again), mean(second)
        x[:, m + 3], x[:, m + 4], x[:, m + 5] = mean(length) / 10, mean(length == 1), mean(length > 20)
        x[:, m + 6] = np.sqrt(np.maximum(mean(length**2) - mean(length) ** 2, 0)) / 10
        x[:, m + 7] = np.log1p(n) / 5
        self.words = (h >> np.uint64(63 - WORD_BITS)).astype(np.uint16)  # the bin's bits and then the sign
        self.words = (self.words >> 1) | ((self.words & 1) << WORD_BITS)

    def encoded(self, i: int, j: int) -> bytes:
        """The passages i to j: their number, surfaces, words and sizes."""
        at = np.concatenate(([0], np.cumsum(self.size, dtype=np.int64)))
        return np.uint32(j - i).tobytes() + self.surface[i:j].tobytes() + self.words[at[i] : at[j]].tobytes() + self.size[i:j].tobytes()


def encode(column: pa.Array) -> list[bytes]:
    p = Passages(column)
    return [p.encoded(a, b) for a, b in zip(p.bounds[:-1].tolist(), p.bounds[1:].tolist(), strict=True)]


def decoded(code: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """surface, words, size of a text's passages."""
    n = int(np.frombuffer(code, np.uint32, 1)[0])
    surface = np.frombuffer(code, np.float32, n * SURFACE, 4).reshape(n, SURFACE)
    size = np.frombuffer(code, np.uint8, n, len(code) - n)
    return surface, np.frombuffer(code, np.uint16, int(size.sum()), 4 + 4 * n * SURFACE), size


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """shift and scale of surfaces; We, be: encoder of surfaces; Ww: a vector for each bin of words; V, U, a: gated attention; w, b: classifier."""

    def __init__(self, shift: np.ndarray, scale: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.shift, self.scale = shift, scale
        self.p = {
            "We": rng.normal(0, SURFACE**-0.5, (SURFACE, HIDDEN)),
            "Ww": np.zeros((BINS, HIDDEN)),  # a word that training has not seen says nothing
            "be": np.zeros(HIDDEN),
            "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "a": rng.normal(0, 0.3, GATE),
            "w": rng.normal(0, 0.3, HIDDEN),
            "b": np.zeros(1),
        }

    def forward(self, surface: np.ndarray, words: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> dict:
        """Scores of bags: passages bounds[i]:bounds[i+1]; an empty bag has only the bias. A passage's words add up, over the root of their number."""
        p = self.p
        x = (surface - self.shift) / self.scale
        to, of_word = (words & (BINS - 1)).astype(np.int64), np.repeat(np.arange(len(size)), size)
        weight = (2.0 * (words >> WORD_BITS) - 1) / np.sqrt(np.maximum(size, 1))[of_word]
        said = np.add.reduceat(p["Ww"][to] * weight[:, None], np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[:-1], axis=0) if len(size) else np.zeros((0, HIDDEN))
        h = np.tanh(x @ p["We"] + said + p["be"])
        tv_, ug = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (tv_ * ug) @ p["a"]
        bags = len(bounds) - 1
        of = np.repeat(np.arange(bags), np.diff(bounds))
        ex = np.exp(np.clip(e, -30, 30))  # |e| is at most the sum of |a|
        total = np.bincount(of, ex, bags)
        alpha = ex / total[of]
        z = np.stack([np.bincount(of, alpha * h[:, j], bags) for j in range(HIDDEN)], 1)
        return {"x": x, "to": to, "of_word": of_word, "weight": weight, "h": h, "t": tv_, "g": ug, "alpha": alpha, "of": of, "z": z, "score": _sigmoid(z @ p["w"] + p["b"])}

    def gradients(self, f: dict, labels: np.ndarray) -> dict:
        p = self.p
        d = (f["score"] - labels) / len(labels)
        dz = d[:, None] * p["w"]
        of, h, alpha = f["of"], f["h"], f["alpha"]
        dalpha = (dz[of] * h).sum(1)
        de = alpha * (dalpha - np.bincount(of, alpha * dalpha, len(labels))[of])
        dtg = de[:, None] * p["a"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = alpha[:, None] * dz[of] + dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - h**2)
        words = np.stack([np.bincount(f["to"], f["weight"] * dx[f["of_word"], j], BINS) for j in range(HIDDEN)], 1)
        return {"We": f["x"].T @ dx, "Ww": words, "be": dx.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (f["t"] * f["g"]).T @ de, "w": f["z"].T @ d, "b": np.array([d.sum()])}


def fit(rows: list[tuple[bytes, int]], rounds: int = 25, batch: int = 200, decay: float = 1e-4) -> Model:
    """Adam over bags of texts in a fixed random order. With one class or none, the model has that class's rate."""
    bags = [decoded(c) for c, _ in rows]
    labels = np.array([y for _, y in rows], np.float64)
    every = np.concatenate([b[0] for b in bags]).astype(np.float64) if bags else np.zeros((0, SURFACE))
    model = Model(every.mean(0) if len(every) else np.zeros(SURFACE), (every.std(0) if len(every) else np.zeros(SURFACE)) + 1e-3)
    if len(set(labels.tolist())) < 2:
        model.p["w"] *= 0
        model.p["b"] += 0.0 if not len(labels) else 5 * (2 * labels[0] - 1)
        return model
    rng, adam, slow = np.random.default_rng(9), labelled.Adam(0.01), labelled.Adam(0.002)  # a word is seen in few texts, so its vector moves less
    for _ in range(rounds):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            bounds = np.concatenate(([0], np.cumsum([len(bags[i][2]) for i in pick])))
            f = model.forward(*(np.concatenate([bags[i][part] for i in pick]) for part in range(3)), bounds)
            adam.t, slow.t = adam.t + 1, slow.t + 1
            for k, g in model.gradients(f, labels[pick]).items():
                model.p[k] = (slow if k == "Ww" else adam).step(k, model.p[k], g + decay * model.p[k])
    return model


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, text: str = "text") -> Model:
    """Fit on about labelled.SAMPLE labelled texts with crc32(doc_id) mod modulus other than held_out."""
    return fit(labelled.sample(labelled.chosen(docs, labels, "quality", labelled.bucket(F.col("doc_id"), modulus) != held_out, text=text), encode))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, score, predicted, passage (the first word of the passage with most attention; null if there is none).

    A null or empty text has no passage and the score of the bias alone. Rows are scored one by
    one: repeated rows, null ids and texts of any length are kept; an empty table gives no rows;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches, "text"):
            p = Passages(batch.column("text"))
            f = model.forward(p.surface.astype(np.float64), p.words, p.size, p.bounds)
            order = np.lexsort((f["alpha"], f["of"]))
            best = [None] * p.texts.n
            for i in np.flatnonzero(np.diff(p.bounds)).tolist():
                best[i] = int(order[p.bounds[i + 1] - 1] - p.bounds[i]) * PASSAGE
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(f["score"]), pa.array((f["score"] >= 0.5).astype(np.int32)), pa.array(best, pa.int32())], names=["doc_id", "score", "predicted", "passage"]
            )

    rows = cluster.bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, passage int")
