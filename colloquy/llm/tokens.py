"""Token ids of whole texts by the tokenizers library, with repeated pieces encoded once.

A text is cut at places where the tokenizer's own splitting always has a boundary, so the
ids of a text are the ids of its pieces in order; tests hold this against direct encoding.
Each worker keeps the ids of pieces it has met, up to a bound.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from colloquy.llm import textvec as tv

#: Pieces whose ids a worker keeps, and bytes of text that are encoded at a time.
KEPT_PIECES, SLICE_BYTES = 1_000_000, 1 << 19
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
_encoders: dict = {}


def encoder(path: str) -> "Encoder":
    """The process's encoder for a tokenizer file; workers are reused from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _byte_chars() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """ids of a slice of texts. Literal special tokens in a text count as ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.spaced = self.tokenizer.normalizer is None  # white space is part of the pieces
        self.chars = _byte_chars()
        self.word_end = np.zeros(self.size, bool)
        if not self.spaced:
            self.word_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, self.dtype)

    def pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sep = tv.IS_SEP[data]
        begin = np.zeros(n, bool)
        begin[1:] = _PUNCT[data[1:]] & _ASCII_LETTER[data[:-1]]
        if self.spaced:
            # solid: no Unicode white space ends (before) or starts (after) here
            plain = ~sep & (data > 32) & (data < 127)
            before = plain.copy()
            before[1:] |= (data[1:] >= 128) & (data[1:] < 192) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
            after = plain | ((data >= 0xC3) & (data <= 0xDF))
            alone = np.zeros(n, bool)
            alone[1:-1] = before[:-2] & after[2:]
            begin |= alone & (data == 32)
            newline = alone & (data == 10)
            begin |= newline
            begin[1:] |= newline[:-1]
            begin[offs[:-1][offs[:-1] < offs[1:]]] = True
            start = np.flatnonzero(begin)
            return start, np.append(start[1:], n)
        word = ~sep
        begin &= word
        first = word.copy()
        first[1:] &= sep[:-1]
        begin |= first
        full = offs[:-1] < offs[1:]
        begin[offs[:-1][full]] |= word[offs[:-1][full]]
        last = np.zeros(n, bool)
        last[:-1] = word[:-1] & (sep[1:] | begin[1:])
        last[-1] = word[-1]
        last[offs[1:][full] - 1] |= word[offs[1:][full] - 1]
        return np.flatnonzero(begin), np.flatnonzero(last) + 1

    def __call__(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by end_id, and the texts' bounds in them."""
        data, offs = tv.raw(column)
        start, end = self.pieces(data, offs)
        key = tv.mix(tv.spans(tv.prefix(tv._BYTE[data], tv._R), start, end, tv._R), 5)
        unique, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > KEPT_PIECES:
            self.forget()
        spot = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == unique[inside]
        if not known.all():
            self.learn(data, unique[~known], start[where[~known]], end[where[~known]])
            spot = np.searchsorted(self.keys, unique)
        at, length = self.at[spot], self.length[spot].astype(np.int64)
        per_piece = length[inverse]
        flat = self.ids[tv.ragged(at[inverse], per_piece)]
        upto = np.concatenate(([0], np.cumsum(per_piece)))[np.searchsorted(start, offs)]
        out = np.insert(flat, upto[1:], end_id) if len(offs) > 1 else flat
        return out, upto + np.arange(len(upto))

    def learn(self, data: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        buf = data.tobytes()
        letter = _ASCII_LETTER[data] | (data == 0xC3)
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        odd = np.concatenate(([0], np.cumsum(~letter)))
        lead = (data[start] == 32).astype(np.int64) if self.spaced else 0
        simple = (odd[end] == odd[start + lead]) & (end > start + lead)
        got: list = [None] * len(keys)
        easy, hard = np.flatnonzero(simple).tolist(), np.flatnonzero(~simple).tolist()
        s, e = start.tolist(), end.tolist()
        if self.spaced:
            tokenize, chars = self.tokenizer.model.tokenize, self.chars
            for i in easy:
                got[i] = [t.id for t in tokenize(buf[s[i] : e[i]].decode("latin-1").translate(chars))]
        elif easy:
            groups = [easy[i : i + 512] for i in range(0, len(easy), 512)]
            whole = [b" ".join(buf[s[i] : e[i]] for i in group).decode("utf-8", "replace") for group in groups]
            for group, x in zip(groups, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
                ids = x.ids
                stop = (np.flatnonzero(self.word_end[ids]) + 1).tolist()
                if len(stop) == len(group):
                    for i, p, q in zip(group, [0, *stop], stop, strict=False):
                        got[i] = ids[p:q]
                else:
                    hard += group
        if hard:
            for i, x in zip(hard, self.tokenizer.encode_batch_fast([buf[s[i] : e[i]].decode("utf-8", "replace") for i in hard], add_special_tokens=False), strict=True):
                got[i] = x.ids
        length = np.array([len(x) for x in got], np.int32)
        at = len(self.ids) + np.concatenate(([0], np.cumsum(length)[:-1])).astype(np.int64)
        self.ids = np.concatenate([self.ids, np.fromiter((y for x in got for y in x), self.dtype, int(length.sum()))])
        spot = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.length = np.insert(self.keys, spot, keys), np.insert(self.at, spot, at), np.insert(self.length, spot, length)

