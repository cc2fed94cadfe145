"""Removing word sequences that earlier documents hold.

Difference-cover anchors: short word sequences are hashed only at places that lie in a cover
modulo a period. Two copies of a long enough passage then share an aligned anchor whatever
their places, so only the surroundings of anchors that two different texts share are extended
to whole windows and compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm import cluster
from colloquy.llm import textvec as tv
from colloquy.llm.textvec import mix


#: Bytes of text within which places with equal anchors or windows are settled together.
SETTLED_BYTES = 1 << 19
#: Anchors that a task remembers as shared by two texts, so that a very common one does not go on from every slice.
KNOWN_ANCHORS = 1 << 16
#: Bits of a text's hash that tell texts under one doc_id apart.
SHORT = 0x7FFF_FFFF
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def difference_cover(period: int) -> list[int]:
    """Residues whose pairwise differences give every residue, greedily and then pruned; for a period q*q+q+1 with prime q the perfect set of q+1."""
    if period in PERFECT:
        return PERFECT[period]
    cover = [0]
    while len({(a - b) % period for a in cover for b in cover}) < period:
        have = {(a - b) % period for a in cover for b in cover}
        cover.append(max((x for x in range(period) if x not in cover), key=lambda x: len({(x - a) % period for a in cover} | {(a - x) % period for a in cover} - have)))
    return sorted(cover)


#: Perfect difference sets.
PERFECT = {7: [0, 1, 3], 13: [0, 1, 3, 9], 21: [3, 6, 7, 12, 14], 31: [1, 5, 11, 24, 25, 27]}


def settings(window: int) -> tuple[int, list[int], int]:
    """Period, cover and anchor length for windows of so many words: period - 1 + anchor = window, so any window pair holds a common anchor."""
    period = max((p for p in PERFECT if p - 1 <= 0.65 * window), default=1)
    return period, (difference_cover(period) if period > 1 else [0]), window - period + 1


def anchor_places(texts: tv.Texts, window: int) -> np.ndarray:
    """Words at which an anchor starts, in texts that have a whole window."""
    period, cover, length = settings(window)
    at = np.arange(texts.n_words)
    end = texts.last_word()
    begin = np.repeat(texts.bounds[:-1], texts.counts)
    is_cover = np.zeros(period, bool)
    is_cover[[c % period for c in cover]] = True
    return at[is_cover[(at - begin) % period] & (at + length <= end) & (end - begin >= window)]


def settled(h: np.ndarray, tk: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places are known to have an anchor that two texts share, and the anchors (sorted) that are known so from these places.

    Of the places of an anchor that is new to `known` (sorted) one of the smallest and one of the
    largest text go on, from which all other tasks learn that it is shared."""
    spot = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    sure = known[spot] == h if len(known) else np.zeros(len(h), bool)
    order = np.lexsort((tk, h))
    order = order[~sure[order]]
    if not len(order):
        return sure, known[:0]
    hs, ts = h[order], tk[order]
    first = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1])))
    last = np.append(first[1:], len(hs)) - 1
    shared = ts[first] != ts[last]
    inner = np.repeat(shared, last - first + 1)
    inner[first] = inner[last] = False
    sure[order[inner]] = True
    return sure, hs[first[shared]]


def deduplicate(docs: DataFrame, window: int = 50, text: str = "text", as_documents: bool = False, length: str = "n_chars") -> DataFrame:
    """Remove each word that a window covers whose word sequence also starts in a text with a smaller doc_id.

    docs: doc_id, text. Returns doc_id, n_words, n_removed, kept_text (the kept words joined by
    one space), kept_sha256 (of it, in UTF-8): one row per row of docs.

    Windows are judged on the input. Whole copies are settled by their smallest doc_id; of other
    texts only windows around shared anchors are compared, by 96 bits of hash. A place whose anchor
    is seen to be shared where it lies does not meet the others of that anchor, and places with
    equal windows in one slice of texts are one row of the shuffle, so very common passages are
    spread over tasks. Smallest doc_ids of windows are combined before
    the shuffle, and joined back, which Spark splits where a window is very common.

    A null text has no words. Rows with one doc_id never remove each other's words, repeated rows get equal
    results, and a row with a null doc_id is left as it is and removes nothing. Texts shorter
    than a window are kept whole. An empty table gives no rows; other columns are not read.

    as_documents: returns rows like those of docs instead, with all columns whatever their names. A text
    that loses words becomes its kept text (and the column `length`, if it is there and holds whole numbers,
    its number of characters), others stay as they are, null too; a text that loses its last word goes.
    """
    _, _, anchor = settings(window)
    names = docs.columns
    others = [c for c in names if c != text]
    place_of = {c: f"c{i}" for i, c in enumerate(others)}
    counted = length if length in others and isinstance(docs.schema[length].dataType, INTEGRAL) else None
    rest = F.struct(*(F.col(f"`{c}`").alias(place_of[c]) for c in others), F.col(f"`{text}`").isNull().alias("empty")).alias("rest")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keys = [F.col("doc_id").cast("long").alias("doc_id"), body.alias("text")]
    rows = cluster.bounded_batches(docs).select(*keys, F.xxhash64(body).alias("tk"), *([rest] if as_documents else []))
    known = rows.filter("doc_id is not null")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every place of an anchor; those known to be shared under a hash of their own, which no other place has but by chance."""
        common = np.zeros(0, np.uint64)
        for batch in tv.slices(batches, "text", SETTLED_BYTES):
            t = tv.Texts(batch.column("text"))
            at = anchor_places(t, window)
            h = tv.sequences(tv.sequence_prefix(t.word_hashes()), at, anchor)
            of = np.searchsorted(t.bounds, at, side="right") - 1
            tk, doc, pos = batch.column("tk").to_numpy()[of], batch.column("doc_id").to_numpy()[of], at - t.bounds[of]
            sure, new = settled(h, tk, common)
            if len(new) and len(common) + len(new) <= KNOWN_ANCHORS:
                common = np.sort(np.concatenate((common, new)))
            own = mix(doc.view(np.uint64) + mix(pos.astype(np.uint64), 91), 92)
            yield pa.RecordBatch.from_arrays(
                [tv.as_long(np.where(sure, own, h)), pa.array(tk), pa.array(doc), pa.array(np.where(sure, -1 - pos, pos).astype(np.int32))], names=["h", "tk", "doc_id", "pos"]
            )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows around hits: a row for each window of the slice with a place of its smallest doc_id, which holds all its other places in `more`."""
        for batch in tv.slices(batches, "text", SETTLED_BYTES):
            t = tv.Texts(batch.column("text"))
            near = np.zeros(t.n_words + 1, np.int64)
            hits = batch.column("hits")
            at = hits.flatten().to_numpy().astype(np.int64)
            of = np.repeat(np.arange(t.n), hits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            ok = at + anchor <= t.counts[of]
            of, at = of[ok], at[ok]
            # windows that hold the whole anchor start in [at + anchor - window, at]
            np.add.at(near, t.bounds[of] + np.maximum(0, at + anchor - window), 1)
            np.add.at(near, t.bounds[of] + at + 1, -1)
            last = t.last_word()
            start = np.arange(t.n_words)
            start = start[(np.cumsum(near)[:-1] > 0) & (start + window <= last)]
            hashes = t.word_hashes()
            w1 = tv.sequences(tv.sequence_prefix(hashes), start, window)
            w2 = tv.sequences(tv.sequence_prefix(hashes, 7), start, window, 1)
            of = np.searchsorted(t.bounds, start, side="right") - 1
            doc = batch.column("doc_id").to_numpy()[of]
            order = np.lexsort((doc, w2, w1))
            new = np.ones(len(order), bool)
            new[1:] = (w1[order[1:]] != w1[order[:-1]]) | (w2[order[1:]] != w2[order[:-1]])
            group = np.cumsum(new) - 1
            head = order[new]
            more = order[~new]
            count, begin = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            count[head] = np.bincount(group[~new], minlength=len(head))
            begin[head] = np.cumsum(count[head]) - count[head]
            use = np.sort(head)  # back in the texts' order, in which rows compress well
            more = more[tv.ragged(begin[use], count[use])]
            th = (batch.column("tk").to_numpy()[of] & SHORT).astype(np.int32)
            pos = (start - t.bounds[of]).astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(count[use]))).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(doc[more]), pa.array(th[more]), pa.array(pos[more])], names=["doc_id", "th", "pos"]),
                mask=pa.array(count[use] == 0),
            )
            yield pa.RecordBatch.from_arrays(
                [tv.as_long(w1[use]), pa.array(w2[use].astype(np.uint32).view(np.int32)), pa.array(doc[use]), pa.array(th[use]), pa.array(pos[use]), lists],
                names=["w1", "w2", "doc_id", "th", "pos", "more"],
            )

    def documents(batch: pa.RecordBatch, t: tv.Texts, keep: np.ndarray, removed: np.ndarray) -> pa.RecordBatch:
        inner = batch.column("rest")
        new = batch.column("text").to_pylist()
        empty = inner.field("empty").to_pylist()
        for i in range(t.n):
            new[i] = None if empty[i] else t.kept(i, keep).decode("utf-8", "replace") if removed[i] else new[i]
        columns = []
        for name in names:
            if name == text:
                columns.append(pa.array(new, pa.string()))
            elif name == counted:
                old = inner.field(place_of[name])
                columns.append(pa.array([len(new[i]) if removed[i] else x for i, x in enumerate(old.to_pylist())], old.type))
            else:
                columns.append(inner.field(place_of[name]))
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array((removed == 0) | (removed < t.counts)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches, "text"):
            t = tv.Texts(batch.column("text"))
            drop = np.zeros(t.n_words + 1, np.int64)
            for i, (tk, facts) in enumerate(zip(batch.column("tk").to_pylist(), batch.column("facts"), strict=True)):
                for fact in facts if facts.is_valid else ():
                    if fact["th"].as_py() != tk & SHORT:
                        continue
                    if fact["copy"].as_py() and t.counts[i] >= window:
                        drop[t.bounds[i]] += 1
                        drop[t.bounds[i + 1]] -= 1
                    elif fact["cut"].is_valid:
                        at = t.bounds[i] + fact["cut"].values.to_numpy()
                        np.add.at(drop, at, 1)
                        np.add.at(drop, at + window, -1)
            keep = np.cumsum(drop)[:-1] == 0
            removed = t.counts - np.diff(np.concatenate(([0], np.cumsum(keep)))[t.bounds])
            if as_documents:
                yield documents(batch, t, keep, removed)
                continue
            kept = [t.kept(i, keep) for i in range(t.n)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(t.counts.astype(np.int64)),
                    pa.array(removed.astype(np.int64)),
                    pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    # a negative position is a place whose anchor is known to be shared
    same = Window.partitionBy("h")
    marked = known.select("doc_id", "text", "tk").mapInArrow(places, "h long, tk long, doc_id long, pos int").withColumns({"a": F.min("tk").over(same), "b": F.max("tk").over(same)})
    hits = marked.filter("pos < 0 or a <> b").groupBy("doc_id").agg(F.collect_set(F.expr("if(pos < 0, -1 - pos, pos)")).alias("hits"))

    identity = known.filter(F.length("text") >= 2 * window - 1).select("doc_id", "tk", F.hash("text").alias("tk2"), F.length("text").alias("n"))
    first = identity.groupBy("tk", "tk2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep < last")
    copies = identity.join(first, ["tk", "tk2", "n"]).filter("doc_id > rep").select("doc_id", "tk").distinct().withColumn("copy", F.lit(True))

    # every join with the texts is on doc_id alone, so that they are shuffled once
    whole = copies.groupBy("doc_id").agg(F.collect_set("tk").alias("whole"))
    around = known.join(hits.join(whole, "doc_id", "left"), "doc_id").filter(~F.coalesce(F.array_contains("whole", F.col("tk")), F.lit(False)))
    # equal rows of a window take the same way however the texts are cut into slices, so both evaluations agree
    found = around.mapInArrow(windows, "w1 long, w2 int, doc_id long, th int, pos int, more array<struct<doc_id:long,th:int,pos:int>>")
    smallest = found.groupBy("w1", "w2").agg(F.min("doc_id").alias("rep"))
    ranked = found.join(smallest, ["w1", "w2"]).filter("doc_id > rep or more is not null")
    later = ranked.selectExpr("inline(filter(concat(array(struct(doc_id, th, pos)), coalesce(more, array())), x -> x.doc_id > rep))")
    cut = later.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("cut"))

    facts = cut.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", F.col("tk").bitwiseAND(F.lit(SHORT)).cast("int").alias("th"), "copy", F.lit(None).cast("array<int>").alias("cut")))
    by_doc = facts.groupBy("doc_id").agg(F.collect_list(F.struct("th", "copy", "cut")).alias("facts"))
    out = docs.schema if as_documents else "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    unknown = rows.filter("doc_id is null").withColumn("facts", F.lit(None).cast("array<struct<th:int,copy:boolean,cut:array<int>>>"))
    return known.join(by_doc, "doc_id", "left").mapInArrow(finish, out).union(unknown.mapInArrow(finish, out))
