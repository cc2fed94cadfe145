"""Benchmark decontamination by spaced seeds.

Fixed masks select six words of a window and ignore the others, so a hash of the selected
words survives substitutions elsewhere. Hashes of benchmark items and of texts are joined, and
around each hit the two sequences are laid side by side and their equal words counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import cluster
from colloquy.llm import textvec as tv

WINDOW, SHARE, LEAST_ITEM = 15, 0.8, 8
#: Words of an item from which on a text that holds all of it, word for word, counts as contaminated where documents are dropped; overlaps are reported from one word on with least_item=1.
LEAST_VERBATIM = 3
#: Word places within a window. Any three substitutions in 15 words leave one of these whole somewhere (tested).
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 8, 9, 10), (0, 1, 3, 5, 6, 10))
#: Words of benchmark that are sent to tasks at a time; more are taken in blocks of items.
BLOCK_WORDS = 200_000
#: Pairs of a place in a text and one in an item that are looked at together.
PAIRS = 500_000


def needed(words: int) -> tuple[int, int]:
    """For an item of so many words: the window compared, and the equal words it needs; all of those of an item below LEAST_ITEM."""
    w = min(words, WINDOW)
    return w, math.ceil(SHARE * w - 1e-9) if words >= LEAST_ITEM else w


def short_run(words: int) -> int:
    """Length of the run of equal words that is sure to be left in a short item."""
    w, k = needed(words)
    return -(-k // (w - k + 1))


def masked(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the masked words at each place where the mask fits."""
    n = max(0, len(hashes) - mask[-1])
    out = np.full(n, len(mask) + 1000 * mask[-1], np.uint64)
    for k in mask:
        out = tv.mix(out ^ hashes[k : k + n], 41)
    return out


class Seeds:
    """Seeds of a block of benchmark items: for each mask the sorted hashes with item and place. Items of fewer than `least` words have none."""

    def __init__(self, texts: list[str | None], least: int = LEAST_ITEM):
        t = tv.Texts(pa.array(texts, pa.string()), fold=True)
        self.words, self.bounds, self.sizes = t.word_hashes(), t.bounds, t.counts
        groups: dict[tuple[int, ...], list[np.ndarray]] = {}
        for i in np.flatnonzero(self.sizes >= least).tolist():
            n = int(self.sizes[i])
            for m in MASKS if n >= WINDOW else (tuple(range(short_run(n))),):
                groups.setdefault(m, []).append(np.array([i]))
        self.tables = []
        for m, items in groups.items():
            keys, item, place = [], [], []
            for i in np.concatenate(items).tolist():
                h = masked(self.words[self.bounds[i] : self.bounds[i + 1]], m)
                keys.append(h)
                item.append(np.full(len(h), i))
                place.append(np.arange(len(h)))
            order = np.argsort(np.concatenate(keys), kind="stable")
            self.tables.append((m, np.concatenate(keys)[order], np.concatenate(item)[order], np.concatenate(place)[order]))

    def hits(self, t: tv.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, item, shift): word j of the item is beside word shift + j of the text."""
        words, last, of = t.word_hashes(), t.last_word(), t.text_of_word()
        out = []
        for m, keys, item, place in self.tables:
            h = masked(words, m)
            at = np.arange(len(h))
            lo = np.searchsorted(keys, h)
            ok = lo < len(keys)
            ok[ok] = keys[lo[ok]] == h[ok]
            at = at[ok & (at + m[-1] < last[: len(h)])]
            lo = lo[at]
            size = np.searchsorted(keys, h[at], side="right") - lo
            # a seed that many items hold meets many places: so many pairs at a time, each kept once
            cut = np.searchsorted(np.cumsum(size), np.arange(PAIRS, int(size.sum()) + PAIRS, PAIRS), side="right") if len(size) else []
            for a, b in zip([0, *cut], [*cut, len(at)], strict=True):
                k, x = tv.ragged(lo[a:b], size[a:b]), np.repeat(at[a:b], size[a:b])
                out.append(np.unique(np.stack([of[x], item[k], x - t.bounds[of[x]] - place[k]], 1), axis=0))
        found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)
        return found[:, 0], found[:, 1], found[:, 2]

    def verified(self, t: tv.Texts) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, equal words, share) of the best window of each hit's alignment that has enough equal words."""
        words = t.word_hashes()
        out = []
        text, item, shift = self.hits(t)
        for a in range(0, len(text), 20_000):
            tx, it, sh = text[a : a + 20_000], item[a : a + 20_000], shift[a : a + 20_000]
            n = self.sizes[it]
            j = tv.ragged(np.zeros(len(n), np.int64), n)
            of = np.repeat(np.arange(len(n)), n)
            place = sh[of] + j
            inside = (place >= 0) & (place < t.counts[tx][of])
            same = np.zeros(len(j), bool)
            same[inside] = words[(t.bounds[tx][of] + place)[inside]] == self.words[(self.bounds[it][of] + j)[inside]]
            total = np.concatenate(([0], np.cumsum(same)))
            w = np.minimum(n, WINDOW)
            begin = np.cumsum(n) - n
            starts = tv.ragged(begin, n - w + 1)
            owner = np.repeat(np.arange(len(n)), n - w + 1)
            equal = total[starts + w[owner]] - total[starts]
            first = np.concatenate(([0], np.cumsum(n - w + 1)[:-1]))
            best = np.maximum.reduceat(equal, first) if len(first) else equal
            need = np.where(n < LEAST_ITEM, w, np.ceil(SHARE * w - 1e-9))
            for i in np.flatnonzero(best >= need).tolist():
                at = int(starts[first[i]] - begin[i] + np.argmax(equal[first[i] : first[i] + n[i] - w[i] + 1]))
                out.append((int(tx[i]), int(it[i]), int(sh[i]) + at, int(best[i]), float(best[i] / w[i])))
        return out


def blocks(benchmark: DataFrame, text: str = "text", most: int = BLOCK_WORDS, least: int = LEAST_ITEM) -> Iterator[tuple[Seeds, list[int], bool]]:
    """The items as Seeds in blocks of about `most` words, by a hash of the item, and whether there is only this block. The driver holds one block at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col(text).alias("text")).filter("text is not null")
    words = items.agg(F.sum(F.size(F.split("text", "[ \\t-\\r]+")))).first()[0] or 0
    n = max(1, -(-words // most))
    for b in range(n):
        rows = sorted(items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect(), key=lambda r: (r.item_id is not None, r.item_id))
        yield Seeds([r.text for r in rows], least), [r.item_id for r in rows], n == 1


FOUND = "array<struct<item_id:long,first_word:int,equal:int,share:double>>"
_FOUND_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int32()), ("equal", pa.int32()), ("share", pa.float64())]))


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS, least_item: int = LEAST_ITEM) -> DataFrame:
    """The benchmark items that each text of docs (doc_id, text) overlaps with.

    Words are compared in lower case. A text overlaps with an item if, laid side by side, some 15
    consecutive places of the item hold at least 12 equal words (for items of 8 to 14 words: 80 % of
    all; for shorter ones all). Every such overlap is found: the masks miss none. Items of fewer than
    least_item words are left out: with 1 none is. Null texts and those without words are left out. An item with a null id counts, with a null item_id in found.

    Returns doc_id, found (item_id, first_word of the best window in the text - negative if the item
    begins before it -, equal, share; ordered), contaminated: one row per row of docs.

    Up to about block_words words of benchmark are sent to tasks at once, and documents are not
    shuffled. A larger benchmark is taken block by block, the overlaps of each written before the next
    is read. A null or empty text overlaps with nothing; repeated rows and null ids are judged one by
    one; an empty table gives no rows; other columns are not read.
    """
    rows = cluster.bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("tk"))
    some = None
    for seeds, ids, alone in blocks(benchmark, "text", block_words, least_item):
        part = rows.mapInArrow(_finder(seeds, ids, None), f"doc_id long, tk long, found {FOUND}")
        if alone:
            return part.select("doc_id", F.sort_array("found").alias("found"), (F.size("found") > 0).alias("contaminated"))
        part = cluster.written(part.filter("size(found) > 0"), "overlaps")
        some = part if some is None else some.union(part)
    merged = some.groupBy(F.col("doc_id").alias("d"), F.col("tk").alias("t")).agg(F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"))
    base = rows.select("doc_id", "tk")
    found = F.sort_array(F.coalesce("found", F.array().cast(FOUND)))
    all_found = base.join(merged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("t")), "left").select("doc_id", found.alias("found"))
    return all_found.select("doc_id", "found", (F.size("found") > 0).alias("contaminated"))


def _finder(seeds: Seeds, ids: list[int], whole: str | None):
    """Rows of (doc_id, tk, found); with whole, the rows that overlap with nothing, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches, whole or "text"):
            t = tv.Texts(batch.column(whole or "text"), fold=True)
            found: list[list[dict]] = [[] for _ in range(t.n)]
            for text, item, first, equal, share in seeds.verified(t):
                found[text].append({"item_id": ids[item], "first_word": first, "equal": equal, "share": share})
            if whole:
                yield batch.filter(pa.array([not x for x in found], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array(found, _FOUND_ARROW)], names=["doc_id", "tk", "found"])

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS, least_item: int = LEAST_ITEM) -> DataFrame:
    """The rows of docs, all columns as they are whatever their names, that overlap with no benchmark item (see overlaps)."""
    bad = None
    rows = cluster.bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("tk"))
    for seeds, ids, alone in blocks(benchmark, "text", block_words, least_item):
        if alone:
            return cluster.filtered(docs, text, lambda name: _finder(seeds, ids, name))  # noqa: B023  called at once
        part = cluster.written(rows.mapInArrow(_finder(seeds, ids, None), f"doc_id long, tk long, found {FOUND}").filter("size(found) > 0").select("doc_id", "tk"), "overlaps")
        bad = part if bad is None else bad.union(part)
    d, t = cluster.fresh(docs, "d"), cluster.fresh(docs, "t")
    bad = bad.distinct().select(F.col("doc_id").alias(d), F.col("tk").alias(t))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(f"`{text}`") == F.col(t)), "left_anti")
