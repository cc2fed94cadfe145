"""A hidden Markov language model over words.

Latent states are trained by Baum-Welch: tasks run the scaled forward and backward recursions over
their texts, and the expected counts are summed across partitions. The likelihood of a whole
text is then exact, by the scaled forward recursion.

The commonest words are emitted by themselves; all others as one of ENDINGS classes by their last
two bytes, and within a class by their smoothed share, so the model is a distribution over all
words, unseen ones included (one unseen word per class).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import cluster, labelled
from colloquy.llm import textvec as tv

STATES, WORDS, ENDINGS, HEAD = 8, 8192, 1024, 262_144
#: Tokens in a stretch of a text within one training sequence, in a training batch, and in a scoring batch.
STRETCH, TRAIN_TOKENS, SCORE_TOKENS = 256, 400_000, 1_000_000
#: Rounds of Baum-Welch that are always made, and nats a token that a further round has to gain.
LEAST_ROUNDS, SETTLED = 12, 1e-3


def ending(t: tv.Texts) -> np.ndarray:
    """Class of each word by its last two bytes, in lower case."""
    fold = np.arange(256)
    fold[65:91] += 32
    last = fold[t.data[t.end - 1]] if t.n_words else np.zeros(0, np.int64)
    second = np.where(t.end - t.start > 1, fold[t.data[np.maximum(t.end - 2, 0)]], 0) if t.n_words else last
    return (tv.mix((last * 256 + second).astype(np.uint64), 71) % np.uint64(ENDINGS)).astype(np.int64)


@dataclass
class Vocabulary:
    """keys: sorted hashes of the HEAD commonest words, with counts and classes; base: of classes of endings, their smoothed size; n, v: tokens and distinct tokens."""

    keys: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    base: np.ndarray
    n: int
    v: int
    unigram: np.ndarray
    words: int

    def look_up(self, h: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """class, count and whether it is in the head, of each word."""
        at = np.searchsorted(self.keys, h)
        ok = at < len(self.keys)
        ok[ok] = self.keys[at[ok]] == h[ok]
        cls, count = 1 + self.words + endings, np.zeros(len(h), np.int64)
        cls[ok], count[ok] = self.classes[at[ok]], self.counts[at[ok]]
        return cls, count, ok


@dataclass
class Hmm:
    """Probabilities: start[s], move[s, s'], emit[class, s]."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def lanes(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences from long to short: order, starts, and for each step how many still run."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    longest = int(n[order[0]]) if len(n) else 0
    running = len(n) - np.searchsorted(n[order][::-1], np.arange(longest), side="right")
    return order, bounds[:-1][order], running


def expected(model: Hmm, seq: np.ndarray, bounds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions over sequences, and their log likelihood.

    first: whether a sequence begins its text. One that continues a text starts from the states' long-run share and adds no start."""
    s = len(model.start)
    order, at, running = lanes(bounds)
    first = first[order]
    # tokens by step and then by sequence, so that each step is one range of them
    off = np.concatenate(([0], np.cumsum(running)))
    seq = seq[at[tv.ragged(np.zeros(len(running), np.int64), running)] + np.repeat(np.arange(len(running)), running)]
    em = np.take(np.ascontiguousarray(model.emit.T, np.float32), seq, axis=1)
    alpha = np.empty_like(em)
    scale = np.empty(len(seq), np.float32)
    move = model.move.astype(np.float32)
    state = np.where(first, model.start[:, None], stationary(model.move)[:, None]).astype(np.float32)
    for t, k in enumerate(running.tolist()):
        p = slice(off[t], off[t + 1])
        a = (state[:, :k] if t == 0 else move.T @ state[:, :k]) * em[:, p]
        c = a.sum(0)
        a /= c
        alpha[:, p], scale[p] = a, c
        state = a
    beta = np.ones((s, len(at)), np.float32)
    moves = np.zeros((s, s))
    for t in range(len(running) - 1, 0, -1):
        k = int(running[t])
        p = slice(off[t], off[t + 1])
        x = beta[:, :k] * em[:, p]
        x /= scale[p]
        moves += alpha[:, off[t - 1] : off[t - 1] + k] @ x.T
        em[:, p] = beta[:, :k]  # from here on em holds beta
        beta[:, :k] = move @ x
    em[:, : len(at)] = beta
    moves *= model.move
    alpha *= em
    emissions = np.stack([np.bincount(seq, alpha[j], len(model.emit)) for j in range(s)], 1)
    starts = alpha[:, : len(at)][:, first].sum(1, dtype=np.float64)
    return starts, moves, emissions, float(np.log(scale, dtype=np.float64).sum())


def log_likelihood(model: Hmm, seq: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence, exact."""
    order, at, running = lanes(bounds)
    total = np.zeros(len(at))
    state = np.tile(model.start, (len(at), 1))
    for t, k in enumerate(running.tolist()):
        a = (state[:k] if t == 0 else state[:k] @ model.move) * model.emit[seq[at[:k] + t]]
        c = a.sum(1)
        total[:k] += np.log10(c)
        state = a / c[:, None]
    out = np.zeros(len(at))
    out[order] = total
    return out


def stationary(move: np.ndarray) -> np.ndarray:
    p = np.full(len(move), 1 / len(move))
    for _ in range(100):
        p = p @ move
    return p / p.sum()


def improved(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, unigram: np.ndarray, strength: float = 50.0) -> Hmm:
    """The model of the expected counts; emissions are pulled towards the classes' overall share with the weight of `strength` tokens, so none is 0."""
    emit = emissions + strength * unigram[:, None]
    return Hmm((starts + 0.1) / (starts + 0.1).sum(), (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True), emit / emit.sum(0))


def stretches(seq: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of stretches of up to STRETCH tokens, and whether each begins a text."""
    n = np.diff(bounds)
    per = -(-n // STRETCH)
    k = tv.ragged(np.zeros(len(n), np.int64), per)
    return np.append(np.repeat(bounds[:-1], per) + k * STRETCH, bounds[-1]), k == 0


def initial(unigram: np.ndarray, states: int, seed: int = 12) -> Hmm:
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * rng.uniform(0.2, 1.8, (len(unigram), states))
    move = rng.uniform(0.5, 1, (states, states)) + 4 * np.eye(states)
    return Hmm(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts of a binary column, one after another, and the texts' bounds."""
    n = len(column)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data.view(np.uint16).astype(np.int64), (offs - offs[0]) // 2


def count_words(rows: DataFrame) -> DataFrame:
    """h, ending, c: counts of the words of rows.text, summed in each slice before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches, "text"):
            t = tv.Texts(batch.column("text"), fold=True)
            h, first, c = np.unique(t.word_hashes(), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([tv.as_long(h), pa.array(ending(t)[first].astype(np.int32)), pa.array(c.astype(np.int64))], names=["h", "ending", "c"])

    return rows.mapInArrow(run, "h long, ending int, c long").groupBy("h", "ending").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, texts: int, head_words: int = HEAD, words: int = WORDS) -> Vocabulary:
    """From word counts of the training texts and their number. What comes to the driver is bounded: the head_words commonest words and sums by ending."""
    times = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(head_words).collect()
    least, size = 1 << 62, 0
    for r in times:
        if size + r.n > head_words:
            break
        least, size = r.c, size + r.n
    head = counts.filter(F.col("c") >= least).toArrow()
    h = head.column("h").to_numpy().view(np.uint64)
    c, end = head.column("c").to_numpy(), head.column("ending").to_numpy().astype(np.int64)
    cls = 1 + words + end
    cls[np.lexsort((h, -c))[:words]] = 1 + np.arange(min(words, len(h)))
    order = np.argsort(h)
    total, distinct = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        total[r.ending], distinct[r.ending] = r.c, r.n
    n, v = int(total.sum()) + texts, int(distinct.sum()) + (texts > 0)
    own = cls <= words
    np.subtract.at(total, end[own], c[own])
    np.subtract.at(distinct, end[own], 1)
    unigram = np.full(1 + words + ENDINGS, 0.1)
    unigram[0] += texts
    unigram[1 + words :] += total
    unigram[cls[own]] += c[own]
    return Vocabulary(h[order], c[order], cls[order], total + 0.1 * (distinct + 1), n, v, unigram / unigram.sum(), words)


ENCODED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, head_log double, mid_log double, seq binary, tail binary"


def encode(rows: DataFrame, shared) -> DataFrame:
    """Each text as classes, with what the head tells of it and the hashes of its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, ends = shared.value
        rid = TaskContext.get().partitionId() << 40
        for batch in tv.slices(batches, "text"):
            t = tv.Texts(batch.column("text"), fold=True)
            h = t.word_hashes()
            end = ending(t)
            cls, count, head = voc.look_up(h, end)
            of = t.text_of_word()
            log = np.where(head, np.log10(count + 0.1), 0.0)
            single = cls <= voc.words
            base = np.log10(voc.base)
            mid = np.where(single, 0.0, log - base[end])
            final = np.log10(ends + 0.1)
            seq = np.insert(cls.astype(np.uint16), t.bounds[1:], 0)
            at = t.bounds + np.arange(t.n + 1)
            where = np.searchsorted(np.flatnonzero(~head), t.bounds)
            tail = h[~head]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rid + np.arange(t.n)),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(t.counts + 1),
                    pa.array(np.bincount(of, head, t.n).astype(np.int64) + int(ends > 0)),
                    pa.array(np.bincount(of, log, t.n) + final),
                    pa.array(np.bincount(of, mid, t.n)),
                    pa.array([seq[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    pa.array([tail[a:b].tobytes() for a, b in zip(where[:-1], where[1:], strict=True)], pa.binary()),
                ],
                names=[x.split()[0] for x in ENCODED.split(", ")],
            )
            rid += t.n

    return rows.mapInArrow(run, ENCODED)


def tail_sums(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """rid, known, log: over a text's words outside the head, those with a count, and the sum of log10(count + 0.1), by an exact join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x, np.uint64) for x in batch.column("tail").to_pylist()]
            h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([tv.as_long(h), pa.array(np.repeat(batch.column("rid").to_numpy(), [len(p) for p in parts]))], names=["h", "rid"])

    words = encoded.filter(F.length("tail") > 0).select("rid", "tail").mapInArrow(run, "h long, rid long")
    found = words.join(counts.select("h", "c"), "h", "left")
    return found.groupBy("rid").agg(F.count("c").alias("known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("log"))


def baum_welch(encoded: DataFrame, texts: int, unigram: np.ndarray, states: int, rounds: int, least_rounds: int = LEAST_ROUNDS, settled: float = SETTLED) -> Hmm:
    """Rounds over all training texts, `texts` in number, from a random start, until the likelihood settles: from least_rounds on, until a round gains less than `settled` nats a token; `rounds` at most."""
    spark = encoded.sparkSession
    training = encoded.filter("not held_out")
    model = initial(unigram, states)
    if not texts:
        return model
    classes = len(unigram)
    schema = "k int, " + ", ".join(f"v{j} double" for j in range(states))
    before = -math.inf
    for done in range(1, rounds + 1):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((classes + states + 2, states))
            for batch in batches:  # all of a task's texts add up here, so a shuffle holds one row a class and task
                seq, bounds = _sequences(batch.column("seq"))
                cut, first = stretches(seq, bounds)
                a = 0
                while a < len(first):
                    b = max(a + 1, int(np.searchsorted(cut, cut[a] + TRAIN_TOKENS, side="right")) - 1)
                    starts, moves, emissions, log = expected(sent.value, seq[cut[a] : cut[b]], cut[a : b + 1] - cut[a], first[a:b])
                    total[:classes] += emissions
                    total[classes : classes + states] += moves
                    total[-2] += starts
                    total[-1, 0] += log
                    a = b
            k = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), *(pa.array(total[k, j]) for j in range(states))], names=["k", *(f"v{j}" for j in range(states))])

        got = training.select("seq").mapInArrow(run, schema).groupBy("k").agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in range(states))).toArrow()
        total = np.zeros((classes + states + 2, states))
        total[got.column("k").to_numpy()] = np.stack([got.column(f"v{j}").to_numpy() for j in range(states)], 1)
        model = improved(total[-2], total[classes : classes + states], total[:classes], unigram)
        sent.unpersist()
        now = total[-1, 0] / total[:classes].sum()
        if done >= least_rounds and now - before < settled:
            break
        before = now
    return model


def score(docs: DataFrame, held_out: int = 10, states: int = STATES, rounds: int = 3, warm_rounds: int = 25, head_words: int = HEAD, words: int = WORDS, text: str = "text") -> DataFrame:
    """Score every text of docs (doc_id, text), learning from those with crc32(doc_id) mod held_out not 0.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (with a count), train_tokens,
    base_score (unigrams with 0.1 added) and score (the model's log10 probability of the text).

    Word counts, the join of rare words with them and all rounds of Baum-Welch cover all training
    texts; rounds go on from a random start until the likelihood settles (see baum_welch), warm_rounds + rounds at most.
    Training cuts texts longer than STRETCH tokens into stretches; scoring does not. Words are told
    apart by 64 bits of hash, A-Z in lower case.

    A null or empty text is the end alone. Rows with a null doc_id count as held out. Repeated rows
    count and are scored each. Without training texts base_score is 0 for every text. An empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = cluster.bounded_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("doc_id").isNull() | (labelled.bucket(F.col("doc_id"), held_out) == 0)).alias("held_out"), F.col(text).alias("text")
    )
    training = rows.filter("not held_out")
    counts = cluster.written(count_words(training), "counts")
    texts = training.count()
    voc = vocabulary(counts, texts, head_words, words)
    shared = spark.sparkContext.broadcast((voc, texts))
    encoded = cluster.written(encode(rows, shared), "encoded")
    model = baum_welch(encoded, texts, voc.unigram, states, warm_rounds + rounds)
    final = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, bounds = _sequences(batch.column("seq"))
            logs, a = [], 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + SCORE_TOKENS, side="right")) - 1)
                logs.append(log_likelihood(final.value, seq[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]))
                a = b
            log = pa.array(np.concatenate(logs) if logs else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "doc_id", "held_out", "n_tokens", "n_known", "head_log", "mid_log")), log], names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "head_log", "mid_log", "log"])

    # log10 of the sizes of the classes of words outside the head are in mid_log, their counts in tail_sums
    scored = encoded.drop("tail").mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, head_log double, mid_log double, log double")
    tail = F.coalesce("t.log", F.lit(0.0))
    per_token = math.log10(voc.n + 0.1 * (voc.v + 1))
    return scored.alias("s").join(tail_sums(encoded, counts).alias("t"), "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(voc.n).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("s.log") + F.col("mid_log") + tail).alias("score"),
    )
