"""Sets of word shingles of texts."""

from __future__ import annotations

import numpy as np

from colloquy.llm import textvec as tv

WORDS = 5


class ShingleSets:
    """The distinct shingles of each text of a slice, by text and then hash; a text with fewer words than a shingle has one of all its words, an empty text none."""

    def __init__(self, texts: tv.Texts, words: int = WORDS):
        n = texts.counts
        length = np.minimum(n, words)
        per = np.where(n > 0, n - length + 1, 0)
        start = tv.ragged(texts.bounds[:-1], per)
        of = np.repeat(np.arange(texts.n), per)
        h = tv.sequences(tv.sequence_prefix(texts.word_hashes()), start, length[of])
        order = np.argsort(h)
        of = of[order]
        order = order[np.argsort(of.astype(np.uint16) if texts.n < 1 << 16 else of, kind="stable")]
        h, of = h[order], np.repeat(np.arange(texts.n), per)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        self.hashes, self.of = h[new], of[new]
        self.bounds = np.searchsorted(self.of, np.arange(texts.n + 1))
        self.sizes = np.diff(self.bounds)

    def identity(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that are equal for equal sets, as two arrays."""
        out = []
        for salt in (21, 22):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tv.mix(self.hashes, salt), dtype=np.uint64)))
            with np.errstate(over="ignore"):
                out.append(tv.mix(total[self.bounds[1:]] - total[self.bounds[:-1]], salt))
        return out[0], out[1]

    def signatures(self, count: int) -> np.ndarray:
        """MinHash values, a row for each text; those of empty sets mean nothing."""
        out = np.zeros((len(self.sizes), count), np.uint32)
        full = np.flatnonzero(self.sizes)
        if len(full):
            rng = np.random.default_rng(77)
            a = rng.integers(1 << 31, size=count, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
            x = (self.hashes >> np.uint64(32)).astype(np.uint32)
            y = self.hashes.astype(np.uint32) | np.uint32(1)
            at = self.bounds[:-1][full]
            for i in range(count):
                # x * a + y * b: each set element has a line of its own, so the order under one i says little about that under another
                out[full, i] = np.minimum.reduceat((x ^ (y * a[i])) * a[i - 1], at)
        return out
