"""A BM25 index that is kept up to date: deltas of postings, and figures that add up.

Each change is a generation: the postings of new texts, the keys whose older postings no longer count, and what
document frequencies, the number of documents and their lengths change by. Texts indexed before are not read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import bm25
from colloquy.sources import store

#: Most changed keys that are sent to tasks to find their older postings; more are joined.
SENT_KEYS = 200_000


class Stored:
    """The index of documents (key, text) below a folder that all executors share.

    A generation counts once its figures are there, which are written last; a change that was cut short is overwritten by the next one.
    One change runs at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str = "long", split: Callable[[Column], Column] = tx.tokens):
        self.spark, self.path, self.key, self.split = spark, path.rstrip("/"), key, split
        self.schemas = {
            "postings": f"{key} {kind}, dl int, term string, tf long, gen int",
            "documents": f"{key} {kind}, dl int, gen int",
            "gone": f"{key} {kind}, gen int",
            "frequencies": "term string, df long, gen int",
            "figures": "n long, length long, gen int",
        }

    def _read(self, name: str, upto: int) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}").filter(F.col("gen") <= upto)

    def _write(self, rows: DataFrame, name: str, gen: int) -> None:
        columns = [c.split()[0] for c in self.schemas[name].split(", ")][:-1]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{name}/gen={gen}")

    def generation(self) -> int:
        """The latest one, -1 where there is none."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/figures")
        if not p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
            return -1
        last = self.spark.read.schema(self.schemas["figures"]).parquet(f"{self.path}/figures").agg(F.max("gen")).first()[0]
        return -1 if last is None else last

    def _gone(self, upto: int) -> DataFrame | None:
        """key, _gone: the latest generation that took a key out or anew; None where none did."""
        gone = self._read("gone", upto)
        return gone.groupBy(self.key).agg(F.max("gen").alias("_gone")) if gone.limit(1).count() else None

    def _standing(self, name: str, upto: int) -> DataFrame:
        gone = self._gone(upto)
        return self._read(name, upto) if gone is None else bm25.standing(self._read(name, upto), gone, self.key)

    def live(self) -> DataFrame:
        """The postings that count: those of each key's latest generation, if it was not removed."""
        return self._standing("postings", self.generation()).drop("gen")

    def put(self, docs: DataFrame, text: str) -> None:
        """Index new documents, and anew those whose key is there already. Of several rows of a key in docs that with the greatest text counts; those with a null key are passed over, a null text has no words."""
        once = docs.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(text).alias(text))
        self._change(bm25._posted(once, self.key, [text], self.split, True))

    def remove(self, keys: DataFrame) -> None:
        """Take the documents with these keys out; unknown keys do not matter."""
        none = self.spark.createDataFrame([], self.schemas["postings"]).drop("gen")
        self._change(none, keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct())

    def _change(self, posted: DataFrame, removed: DataFrame | None = None) -> None:
        upto = self.generation()
        gen = upto + 1
        self._write(posted, "postings", gen)
        at = lambda name: self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}").filter(F.col("gen") == gen)
        new = at("postings")
        self._write(new.filter("term is null"), "documents", gen)
        keys = removed if removed is not None else at("documents").select(self.key)
        counts = bm25.counted(new)
        old = at("documents").limit(0)
        if upto >= 0:
            # documents, not postings, tell which keys are there already
            few = keys.limit(SENT_KEYS + 1).count() <= SENT_KEYS
            old = self._standing("documents", upto).join(F.broadcast(keys) if few else keys, self.key, "left_semi")
        old = old.select(self.key, F.col("gen").alias("_old"))
        self._write(old.select(self.key), "gone", gen)
        n_old = at("gone").count()
        if n_old:
            old = store.written(old, "replaced")
            lost = self._read("postings", upto).join(F.broadcast(old) if n_old <= SENT_KEYS else old, self.key).filter("gen = _old")
            less = bm25.counted(lost).select("term", (-F.col("df")).alias("df"), (-F.col("length")).alias("length"))
            counts = counts.union(less).groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))
        counts = store.written(counts, "changes")
        self._write(counts.filter("term is not null and df <> 0"), "frequencies", gen)
        figures = counts.filter("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
        self._write(self.spark.createDataFrame([(figures.n, figures.length)], "n long, length long"), "figures", gen)

    def index(self) -> bm25.Index:
        """The index as it stands; its figures are sums over generations."""
        upto = self.generation()
        total = self._read("figures", upto).agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
        n = total.n or 0
        df = store.written(self._read("frequencies", upto).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0"), "postings-terms")
        raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        mean = df.agg(F.avg(raw).alias("mean")).first().mean if n else None
        return bm25.Index(self._read("postings", upto), self.key, n, total.length / n if n and total.length else 1.0, mean or 0.0, df, self._gone(upto))

    def merged(self, path: str) -> Stored:
        """The same index below another path, in one generation: what scores read then is no more than what counts."""
        out = Stored(self.spark, path, self.key, self.schemas["postings"].split()[1].rstrip(","), self.split)
        out._change(self.live())
        return out
