"""Okapi BM25 as joins over stored postings: document frequencies, scores, cutoffs.

The text is read and split once; postings are written, and everything after reads those.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import text as tx
from colloquy.sources import store

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Most asked terms that are sent to tasks; more are joined.
SENT_TERMS = 200_000
#: Asked terms beyond which scores are summed where the postings of a document lie; sums that a task then holds at a time; most blocks of queries made for that.
FEW_TERMS, SUMS, BLOCKS = 10_000, 3_000_000, 16
#: Postings and asked terms that a task holds where only the best of many queries are sought.
HELD_POSTINGS, HELD_ASKED = 3_000_000, 2_000_000


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files have fewer parts than there are cores."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def postings(docs: DataFrame, key: str, text: str, split: Callable[[Column], Column] = tx.tokens) -> DataFrame:
    """key, term, tf, dl. The words of a document are in one row, so they are sorted and counted there: nothing is shuffled."""
    return _posted(docs, key, [text], split, False).select(key, "dl", "term", "tf")


def _posted(docs: DataFrame, key: str, fields: list[str], split: Callable[[Column], Column], lengths: bool) -> DataFrame:
    """key, field, dl, term, tf of each field in one pass over docs; lengths: and one row a document and field without a term."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.sort_array(split(F.col(f))).alias("terms")) for f in fields)))
    rows = spread(docs.select(key, *fields)).select(key, each.alias("_f")).select(key, "_f.field", "_f.terms", F.size("_f.terms").alias("dl"))
    # where a run of equal words begins, and where the next one does
    begins = F.filter(F.transform("terms", lambda x, i: F.when((i == 0) | (F.get("terms", i - 1) != x), i)), lambda i: i.isNotNull())
    runs = rows.withColumn("begins", begins)
    every = F.arrays_zip(F.col("begins").alias("start"), F.slice("begins", 2, 1 << 30).alias("next"))
    none = F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("next")))
    each_run = runs.select(key, "field", "dl", "terms", F.explode(F.concat(none, every) if lengths else every).alias("_r"))
    tf = F.when(F.col("_r.start").isNotNull(), F.coalesce("_r.next", "dl") - F.col("_r.start")).cast("long")
    return each_run.select(key, "field", "dl", F.get("terms", "_r.start").alias("term"), tf.alias("tf"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.filter("term is not null").groupBy("term").agg(F.count("*").alias("df"))


@dataclass
class Index:
    """Stored postings (key, dl, term, tf; one row a document without a term), the number of documents, their mean length, the mean raw frequency weight of all terms,
    and the documents that each term is in. gone: keys whose postings of generations before `_gone` do not count."""

    posted: DataFrame
    key: str
    n: int
    avgdl: float
    mean: float
    df: DataFrame  # term, df, stored
    gone: DataFrame | None = None  # key, _gone; the postings have gen then

    def weight(self, df: Column) -> Column:
        """Inverse frequency; a negative one becomes EPSILON times the mean over the vocabulary."""
        raw = F.log(F.lit(self.n) - df + 0.5) - F.log(df + 0.5)
        return F.when(raw < 0, F.lit(EPSILON * self.mean)).otherwise(raw)

    def scores(self, queries: DataFrame, query_key: str, query_text: str, split: Callable[[Column], Column] = tx.tokens) -> DataFrame:
        """query_key, key, score of all pairs that share a term; a repeated query term counts each time. Only postings of asked terms leave their task."""
        asked = _asked(queries, query_key, query_text, split)
        n_asked = asked.count()
        if n_asked > FEW_TERMS:
            return self._scores_of_many(asked, query_key, n_asked)
        return self._scores_of_few(asked, query_key, n_asked)

    def best(self, queries: DataFrame, query_key: str, query_text: str, k: int, split: Callable[[Column], Column] = tx.tokens) -> DataFrame:
        """query_key, key, score, rank: the k best of each query, ties by key, as top of the scores. The pairs of many queries are no rows: documents and queries meet in blocks,
        a task sums one query at a time over its documents, and k rows a query and block leave it."""
        asked = _asked(queries, query_key, query_text, split)
        n_asked = asked.count()
        if n_asked <= FEW_TERMS:
            return top(self._scores_of_few(asked, query_key, n_asked), query_key, self.key, k)
        asked = store.written(asked, "asked")
        terms = self.df.join(asked.select("term").distinct(), "term", "left_semi")
        known = store.written(terms.select("term", "df", self.weight(F.col("df")).alias("idf"), F.monotonically_increasing_id().alias("no")), "weights")
        size = known.agg(F.count("*").alias("terms"), F.sum("df").alias("postings")).first()
        blocks = max(2 * asked.sparkSession.sparkContext.defaultParallelism, math.ceil((size.postings or 0) / HELD_POSTINGS))
        parts = math.ceil(n_asked / HELD_ASKED)
        sent = F.broadcast(known) if size.terms <= SENT_TERMS else known
        hit = self.posted.join(sent, "term")
        hit = hit if self.gone is None else standing(hit, self.gone, self.key)
        block, part = F.pmod(F.xxhash64(self.key), F.lit(blocks)), F.pmod(F.xxhash64(query_key), F.lit(parts))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        cell = (F.col("_block") * parts + F.col("_part")).alias("cell")
        docs = hit.select(F.col(self.key).alias("key"), "no", self._gain().alias("gain"), block.alias("_block"), every(parts).alias("_part")).select(cell, "key", "no", "gain")
        wanted = asked.join(sent, "term").select(F.col(query_key).alias("query"), F.col("no").alias("term"), F.col("qtf").cast("double").alias("qtf"), part.alias("_part"), every(blocks).alias("_block")).select(cell, "query", "term", "qtf")
        out = T.StructType([T.StructField(query_key, wanted.schema["query"].dataType), T.StructField(self.key, docs.schema["key"].dataType), T.StructField("score", T.DoubleType())])
        # by number, or Spark would join cells that are small in bytes, though long in work
        met = (x.repartition(2 * blocks * parts, "cell").groupBy("cell") for x in (docs, wanted))
        found = next(met).cogroup(next(met)).applyInArrow(_best_of(k, out.fieldNames()), out)
        return top(found.withColumn("score", F.round("score", 6)), query_key, self.key, k)

    def _scores_of_few(self, asked: DataFrame, query_key: str, n_asked: int) -> DataFrame:
        terms = asked.select("term").distinct()
        small = n_asked <= SENT_TERMS
        stored = self.df.join(F.broadcast(terms) if small else terms, "term", "left_semi")
        wanted = asked.join(stored.select("term", self.weight(F.col("df")).alias("idf")), "term")
        hit = self.posted if self.gone is None else self._counting(F.broadcast(terms) if small else terms)
        return self._summed(hit.join(F.broadcast(wanted) if small else wanted, "term"), query_key)

    def _counting(self, terms: DataFrame) -> DataFrame:
        """The postings of these terms that count; only they meet the keys that are gone."""
        hit = self.posted.join(terms, "term", "left_semi")
        return hit if self.gone is None else standing(hit, self.gone, self.key)

    def _gain(self) -> Column:
        """What a term that is asked once adds to the score of a document."""
        return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(self.avgdl)))

    def _summed(self, met: DataFrame, query_key: str) -> DataFrame:
        return met.groupBy(query_key, self.key).agg(F.round(F.sum(F.col("qtf") * self._gain()), 6).alias("score"))

    def _scores_of_many(self, asked: DataFrame, query_key: str, n_asked: int) -> DataFrame:
        """scores of many queries, whose pairs with documents are far more than the postings. Only these are shuffled, by document, and blocks of queries are sent to them:
        a pair is summed in the task that holds its document, and top leaves k rows a query and task before anything else is shuffled."""
        asked = store.written(asked, "asked")
        terms = asked.groupBy("term").agg(F.count("*").alias("qf"))
        sent = terms.select("term")
        hit = self._counting(F.broadcast(sent) if n_asked <= SENT_TERMS else sent).select(self.key, "dl", "term", "tf")
        known = store.written(terms.join(self.df, "term").select("term", (F.col("qf") * F.col("df")).alias("pairs"), self.weight(F.col("df")).alias("idf")), "weights")
        pairs = known.agg(F.sum("pairs").alias("n")).first().n or 0
        cores = asked.sparkSession.sparkContext.defaultParallelism
        blocks = max(math.ceil(n_asked / SENT_TERMS), min(BLOCKS, math.ceil(pairs / SUMS / cores)), 1)
        rows = hit.repartition(max(cores, math.ceil(pairs / SUMS / blocks)), self.key)
        wanted = store.written(asked.join(known.select("term", "idf"), "term").withColumn("_b", F.pmod(F.xxhash64(query_key), F.lit(blocks))), "wanted")
        return reduce(DataFrame.union, (self._summed(rows.join(F.broadcast(wanted.filter(F.col("_b") == b)), "term"), query_key) for b in range(blocks)))


def _asked(queries: DataFrame, query_key: str, query_text: str, split: Callable[[Column], Column]) -> DataFrame:
    return queries.select(query_key, F.explode(split(F.col(query_text))).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """For each value its place among the different ones in order, and these; a null comes first, as in Spark."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary, null_placement="at_start")
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[coded.indices.to_numpy()], coded.dictionary.take(order)


def _best_of(k: int, names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a block of postings (key, no, gain) and one of asked terms (query, term, qtf) of one cell: the k best documents of each query, ties as the rounded scores have them."""

    def best(docs: pa.Table, asked: pa.Table) -> pa.Table:
        doc, keys = _numbered(docs["key"])
        query, queries = _numbered(asked["query"])
        no, gain = docs["no"].to_numpy(), docs["gain"].to_numpy()
        order = np.lexsort((doc, no))
        doc, no, gain = doc[order], no[order], gain[order]
        once = np.flatnonzero(np.concatenate([[True], (no[1:] != no[:-1]) | (doc[1:] != doc[:-1])])[: len(no)])
        if len(once) < len(no):  # a key that several documents have
            doc, no, gain = doc[once], no[once], np.add.reduceat(gain, once)
        terms, starts = np.unique(no, return_index=True)
        stops = np.append(starts[1:], len(no))
        term = np.searchsorted(terms, asked["term"].to_numpy())
        here = np.flatnonzero(np.append(terms, -1)[term] == asked["term"].to_numpy())
        here = here[np.lexsort((term[here], query[here]))]
        query, term, qtf = query[here], term[here], asked["qtf"].to_numpy()[here]
        begins = np.flatnonzero(np.diff(query, prepend=-1))
        plain = bool((gain > 0).all())
        score = np.zeros(-(-max(len(keys), 1) // 64) * 64)
        groups = score.reshape(64, -1)
        found = []
        for a, z in zip(begins, np.append(begins[1:], len(query)), strict=True):
            score[:] = 0
            places = [slice(starts[t], stops[t]) for t in term[a:z]]
            for p, n in zip(places, qtf[a:z], strict=True):
                score[doc[p]] += gain[p] * n
            if not plain:  # a score may be 0 or less
                met = np.zeros(len(score), bool)
                for p in places:
                    met[doc[p]] = True
                score[~met] = -np.inf
            # k groups have a document as good as the k-th best of their maxima
            tops = groups.max(axis=0)
            least = np.partition(tops, -k)[-k] if len(tops) >= k else -np.inf
            near = np.flatnonzero(score >= least - 2e-6)
            near = near[score[near] > (0 if plain else -np.inf)]
            near = near[np.argsort(-np.round(score[near], 6), kind="stable")[:k]]
            found.append((np.full(len(near), query[a]), near, score[near]))
        q, d, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table([queries.take(pa.array(q)), keys.take(pa.array(d)), pa.array(s)], names=names)

    return best


def standing(posted: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Postings with gen, without those of generations before the one that their key is gone from (key, _gone)."""
    return posted.join(gone, key, "left").filter(F.col("_gone").isNull() | (F.col("gen") >= F.col("_gone"))).drop("_gone")


def counted(posted: DataFrame) -> DataFrame:
    """term, df, length: of the row without a term, the number of documents and their length."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("length"))


def opened(posted: DataFrame, key: str) -> Index:
    """An index over stored postings: what is not stored is computed anew, in one pass over them, and stored."""
    terms = store.written(counted(posted), "postings-terms")
    whole, df = terms.filter("term is null").first(), terms.filter("term is not null").select("term", "df")
    if whole is None:
        return Index(posted, key, 0, 1.0, 0.0, df)
    raw = F.log(F.lit(whole.df) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = df.agg(F.avg(raw).alias("mean")).first().mean
    return Index(posted, key, whole.df, whole.length / whole.df or 1.0, mean or 0.0, df)


def build(docs: DataFrame, key: str, text: str, split: Callable[[Column], Column] = tx.tokens) -> Index:
    """The text is split once and its postings are written to the shared folder."""
    return build_fields(docs, key, [text], split)[text]


def build_fields(docs: DataFrame, key: str, fields: list[str], split: Callable[[Column], Column] = tx.tokens) -> dict[str, Index]:
    """An index of each field; the documents are read once."""
    path = store.shared_dir(docs.sparkSession, "postings")
    posted = _posted(docs, key, fields, split, True)
    posted.write.partitionBy("field").parquet(path)
    read = docs.sparkSession.read.schema(posted.schema).parquet(path)
    return {f: opened(read.filter(F.col("field") == f).drop("field"), key) for f in fields}


def scores(queries: DataFrame, query_key: str, query_text: str, docs: DataFrame, key: str, text: str) -> DataFrame:
    return build(docs, key, text).scores(queries, query_key, query_text)


def field_scores(queries: DataFrame, query_key: str, query_text: str, docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The larger of a document's scores over several fields, each an index of its own; of several queries under one key the largest too."""
    every = None
    for one in build_fields(docs, key, fields).values():
        found = one.scores(queries, query_key, query_text)
        every = found if every is None else every.union(found)
    return every.groupBy(query_key, key).agg(F.max("score").alias("score"))


def relative_cutoff(scored: DataFrame, query_key: str, share: float = 0.6, rounded: bool = True) -> DataFrame:
    """Rows at or above share of the query's best score. rounded: the cutoff to one decimal, half to even, so a small best may let all or none pass; nothing passes without a positive best.

    The best scores are combined in the map tasks and joined back, so no query's rows are sorted in one task."""
    best = scored.groupBy(query_key).agg(F.max("score").alias("_best")).filter("_best > 0")
    cut = F.bround(F.col("_best") * share, 1) if rounded else F.col("_best") * share
    return scored.join(best, query_key).withColumn("cutoff", cut).filter(F.col("score") >= F.col("cutoff")).drop("_best")


def top(scored: DataFrame, query_key: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best of each query with their rank, ties by key; Spark cuts each task's share to k first."""
    w = Window.partitionBy(query_key).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
