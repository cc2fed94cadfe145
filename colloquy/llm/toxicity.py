"""Toxicity by multiple-instance learning: a text is toxic if one of its sentences is.

Each sentence has a probability from the words it holds, a noisy-or combines them, and the
weights are learned from labels of whole texts. The sentences that made the score are located.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import cluster, labelled
from colloquy.llm import textvec as tv

BINS = 1 << 20
STARTS = (4, 6)
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?\n"]] = True


class Sentences:
    """Words of a slice by sentence: features of a word are its first 4 and 6 bytes and itself, in lower case, hashed to BINS."""

    def __init__(self, column: pa.Array):
        t = self.texts = tv.Texts(column, fold=True, separators=NOT_LETTER)
        stop = np.cumsum(ENDS[t.data])
        of = t.text_of_word()
        key = (stop[t.start] if t.n_words else np.zeros(0, np.int64)) + of  # a new text is a new sentence
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        self.sentence = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.text = of[self.first]
        self.bounds = np.searchsorted(self.text, np.arange(t.n + 1))
        self.bins = [(h & np.uint64(BINS - 1)).astype(np.int32) for h in t.start_hashes(STARTS)]


def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text its distinct features with its label, and feature -1 for the text itself."""
    for batch in tv.slices(batches, "text"):
        s = Sentences(batch.column("text"))
        label = np.array(batch.column("label").to_pylist(), np.int32)
        of = s.texts.text_of_word()
        both = np.unique(np.concatenate([of * BINS + b for b in s.bins])) if len(of) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([both % BINS, np.full(s.texts.n, -1)]).astype(np.int32)), pa.array(np.concatenate([label[both // BINS], label]))], names=["bin", "label"])


def encoder(use: np.ndarray):
    """Per text its number of sentences, then the sentence and the index in `use` (sorted) of each used feature, as 32-bit integers."""

    def encode(column: pa.Array) -> list[bytes]:
        s = Sentences(column)
        of = s.texts.text_of_word()
        rows = []
        for b in s.bins:
            at = np.minimum(np.searchsorted(use, b), max(0, len(use) - 1))
            hit = np.flatnonzero(use[at] == b) if len(use) else np.zeros(0, np.int64)
            rows.append(np.stack([of[hit], s.sentence[hit] - s.bounds[of[hit]], at[hit]], 1))
        rows = np.concatenate(rows).astype(np.int32)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        cut = np.searchsorted(rows[:, 0], np.arange(s.texts.n + 1))
        sizes = np.diff(s.bounds).astype(np.int32)
        return [sizes[i : i + 1].tobytes() + rows[cut[i] : cut[i + 1], 1:].tobytes() for i in range(s.texts.n)]

    return encode


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def sentence_scores(self, s: Sentences) -> np.ndarray:
        z = np.full(len(s.first), self.bias)
        if len(z):
            per_word = sum(self.weights[b] for b in s.bins)
            z += np.add.reduceat(per_word, s.first)
        return z

    def score(self, s: Sentences) -> np.ndarray:
        """One minus the product of the sentences' complements; 0 without a word."""
        quiet = np.concatenate(([0.0], np.cumsum(np.logaddexp(0, self.sentence_scores(s)))))
        return np.clip(-np.expm1(-(quiet[s.bounds[1:]] - quiet[s.bounds[:-1]])), 0, 1)


def fit(rows: list[tuple[bytes, int]], use: np.ndarray, first: np.ndarray, rounds: int = 150) -> Model:
    """Weights of the features `use`, starting at `first`, by gradient descent on the noisy-or's likelihood. rows: as encoder(use) makes them, with labels. With one class or none the model has that class's rate."""
    weights = np.zeros(BINS, np.float32)
    labels = np.array([y for _, y in rows], np.float64)
    if not labels.sum() or labels.sum() == len(labels):
        return Model(weights, 20.0 if labels.sum() else -20.0)
    codes = [np.frombuffer(c, np.int32) for c, _ in rows]
    sentences = np.array([c[0] for c in codes])
    begin = np.concatenate(([0], np.cumsum(sentences)))
    size = int(begin[-1])
    text = np.repeat(np.arange(len(rows)), sentences)
    at = np.concatenate([c[1::2] + begin[i] for i, c in enumerate(codes)]).astype(np.int64)
    feature = np.concatenate([c[2::2] for c in codes]).astype(np.int64)
    w, b, adam = first.astype(np.float64), np.float64(-7.0), labelled.Adam(0.1)
    for _ in range(rounds):
        adam.t += 1
        s = b + np.bincount(at, w[feature], size)
        quiet = np.bincount(text, np.logaddexp(0, s), len(rows))
        lift = np.where(labels == 1, -1 / np.expm1(np.maximum(quiet, 1e-9)), 1.0)
        g = lift[text] / (1 + np.exp(-s)) / len(rows)
        w = adam.step("w", w, np.bincount(feature, g[at], len(use)) + 1e-4 * w)
        b = min(adam.step("b", b, g.sum()), -4.0)
    weights[use] = w
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, held_out: int = 5, text: str = "text", least_docs: int = 3, least_z: float = 3.0) -> Model:
    """Fit on about labelled.SAMPLE labelled texts with crc32(doc_id) mod held_out not 0.

    Features that toxic and other texts hold with clearly different frequency are found first, from
    counts summed across tasks; only these are then encoded, so little reaches the driver: at most
    BINS counts, and the used features of the sampled texts.
    """
    rows = labelled.chosen(docs, labels, "toxic", labelled.bucket(F.col("doc_id"), held_out) != 0, text=text)
    got = rows.mapInArrow(presence, "bin int, label int").groupBy("bin").agg(F.sum("label").alias("pos"), F.count("*").alias("n")).filter((F.col("n") >= least_docs) | (F.col("bin") < 0)).toArrow()
    bins, pos, n = (got.column(c).to_numpy().astype(np.float64) for c in ("bin", "pos", "n"))
    n1 = pos[bins < 0].sum()
    n0 = n[bins < 0].sum() - n1
    share = n / max(1.0, n1 + n0)
    z = (pos - n1 * share) / np.sqrt(np.maximum(n1 * share * (1 - share) * n0 / max(1.0, n1 + n0), 1e-9))
    keep = np.flatnonzero((bins >= 0) & (np.abs(z) >= least_z))
    keep = keep[np.argsort(bins[keep])]
    first = np.clip(np.log((pos[keep] + 0.5) / (n1 + 1)) - np.log((n[keep] - pos[keep] + 0.5) / (n0 + 1)), -1, 2)
    use = bins[keep].astype(np.int32)
    return fit(labelled.sample(rows, encoder(use)), use, first)


def score(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, offending of every text.

    offending: the sentences with a probability of at least `least`, with their first byte,
    the byte after their last word, and their probability. A null or empty text, or one without
    letters, scores 0. A sentence ends at . ! ? or a new line. Rows are scored one by one: repeated rows, null ids and texts of any
    length are kept; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches, "text"):
            s = Sentences(batch.column("text"))
            got = model.score(s)
            p = 1 / (1 + np.exp(-np.clip(model.sentence_scores(s), -500, 500)))
            spans: list[list[dict]] = [[] for _ in range(s.texts.n)]
            for i in np.flatnonzero(p >= least).tolist():
                last = (s.first[i + 1] if i + 1 < len(s.first) else s.texts.n_words) - 1
                base = s.texts.offs[s.text[i]]
                spans[s.text[i]].append({"start": int(s.texts.start[s.first[i]] - base), "stop": int(s.texts.end[last] - base), "score": float(p[i])})
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(got), pa.array((got >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())])))],
                names=["doc_id", "score", "predicted", "offending"],
            )

    rows = cluster.bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, offending array<struct<start:int,stop:int,score:double>>")


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are whatever their names, that score below 0.5."""

    def below(name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in tv.slices(batches, name):
                yield batch.filter(pa.array(model.score(Sentences(batch.column(name))) < 0.5))

        return run

    return cluster.filtered(docs, text, below)
