"""Words and their hashes, vectorised over the bytes of an Arrow column.

A batch of texts is one byte buffer with offsets. A word is a maximal run of bytes
other than 0x20 and 0x09-0x0D. Hashes of words are polynomials over their bytes, from
one prefix sum modulo 2**64; hashes of word sequences are polynomials over word hashes.
All cost a few array passes, whatever the number of words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SEP = np.zeros(256, bool)
IS_SEP[list(SEPARATORS)] = True
#: Bytes of text that are worked on at a time; a worker's arrays are some hundred times that.
SLICE_BYTES = 1 << 18
#: Powers kept from slice to slice; a longer text's are computed for it alone.
KEPT_POWERS = 1 << 19

_R, _Q = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values without visible structure (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_BYTE = mix(np.arange(256, dtype=U), 11)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        p = np.full(max(n, 1 << 16), base, U)
        p[0] = 1
        with np.errstate(over="ignore"):
            got = np.cumprod(p, dtype=U)
        if len(got) <= KEPT_POWERS:
            _powers[base] = got
    return got[:n]


@lru_cache
def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """P with P[k] = sum of values[j] * base**j over j < k, modulo 2**64."""
    out = np.zeros(len(values) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def spans(p: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial values of values[start:end], independent of the place."""
    with np.errstate(over="ignore"):
        return (p[end] - p[start]) * powers(inverse(base), len(p))[start]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = column.fill_null("") if column.null_count else column
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[offs[0] : offs[-1]], offs - offs[0]


class Texts:
    """Texts of one slice: bytes, text offsets, words with text bounds and hashes."""

    def __init__(self, column: pa.Array, fold: bool = False, separators: np.ndarray = IS_SEP):
        self.n, self.fold = len(column), fold
        self.data, self.offs = raw(column)
        word = ~separators[self.data]
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        first = self.offs[:-1][self.offs[:-1] < self.offs[1:]]
        last = self.offs[1:][self.offs[:-1] < self.offs[1:]] - 1
        start[first] = word[first]
        end[last] = word[last]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.start, self.offs)
        self.counts = np.diff(self.bounds)

    @property
    def n_words(self) -> int:
        return len(self.start)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def last_word(self) -> np.ndarray:
        """For each word, the index after its text's last word."""
        return np.repeat(self.bounds[1:], self.counts)

    def byte_prefix(self) -> np.ndarray:
        return prefix((_BYTE_FOLDED if self.fold else _BYTE)[self.data], _R)

    def word_hashes(self) -> np.ndarray:
        return mix(spans(self.byte_prefix(), self.start, self.end, _R))

    def start_hashes(self, sizes: tuple[int, ...]) -> list[np.ndarray]:
        """For each size, hashes of the words' first so many bytes (shorter words: of the whole), and last of the whole words."""
        p = self.byte_prefix()
        return [mix(spans(p, self.start, np.minimum(self.start + n, self.end), _R), n) for n in sizes] + [mix(spans(p, self.start, self.end, _R))]

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")

    def kept(self, text: int, keep: np.ndarray) -> bytes:
        """The kept words of a text, joined by a space. keep: over all words."""
        a, b = self.bounds[text], self.bounds[text + 1]
        buf = self.data[self.offs[text] : self.offs[text + 1]].tobytes()
        at = self.offs[text]
        return b" ".join(buf[s - at : e - at] for s, e, k in zip(self.start[a:b], self.end[a:b], keep[a:b], strict=True) if k)


def sequence_prefix(hashes: np.ndarray, salt: int = 0) -> np.ndarray:
    return prefix(mix(hashes, salt) if salt else hashes, _Q)


def sequences(p: np.ndarray, start: np.ndarray, length, salt: int = 0) -> np.ndarray:
    """Hashes of the word sequences at start; p from sequence_prefix."""
    return mix(spans(p, start, start + length, _Q), 101 + salt)


def release() -> None:
    """Give freed memory back to the system: Spark reuses its Python workers, and what one stage has freed is no use to the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that no slice has much more than `most` bytes of text; a longer text is a slice alone. After the last one freed memory goes back to the system."""
    try:
        for batch in batches:
            i = batch.schema.get_field_index(column)
            size = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(size)
            at, base = 0, 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
                yield batch.slice(at, to - at)
                at, base = to, int(total[to - 1])
    finally:
        release()


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ranges starts[i] .. starts[i]+lengths[i]-1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
