"""Keyed tables that are changed in place: rows lie in buckets of their key, and a change rewrites only the buckets it touches.

The buckets are partitions, which Spark's dynamic partition overwrite replaces when the job commits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.tables import last_by_key

BUCKET = "_bucket"


def bucketed(rows: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """rows with their bucket: a hash of the keys as text, so that equal keys of different types meet."""
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(buckets)).cast("int"))


def create(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> None:
    """A new table of rows, one a key. The number of buckets stays as it is: choose it so that a bucket is some hundred MB at the size the table will have."""
    _write(bucketed(rows, keys, buckets), path)


def _write(rows: DataFrame, path: str) -> None:
    rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*(c.split()[0] for c in schema.split(", ")))


def merge(changes: DataFrame, path: str, schema: str, keys: Sequence[str], order: str | None = None, buckets: int = 64, history: Sequence[str] = (), update: bool = True, insert: bool = True) -> int:
    """Bring changes into the table at path (columns of schema): the columns that changes have replace those of the row with their key, all others stay. Returns how many buckets were rewritten.

    Columns named in history are texts to which a change is appended after "; ", unless it is null or what stands last there already, so that a change
    that is brought in twice counts once. update=False: keys that are there stay as they are. insert=False: keys that are not there stay away; else a new row has nulls in what its change lacks.
    Of several changes of a key the last by `order` counts; null keys are passed over. The driver learns only which buckets there are.
    """
    spark, columns = changes.sparkSession, [c.split()[0] for c in schema.split(", ")]
    given = [c for c in changes.columns if c in columns and c not in keys]
    named = changes.dropna(subset=list(keys))
    once = last_by_key(named, list(keys), order) if order else named.dropDuplicates(list(keys))
    new = bucketed(once.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in given), F.lit(True).alias("_new")), keys, buckets)
    touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())
    if not touched:
        return 0
    # the whole table is never read: the filter is on the partition
    old = spark.read.schema(f"{schema}, {BUCKET} int").parquet(path).filter(F.col(BUCKET).isin(touched)).withColumn("_old", F.lit(True))
    both = old.join(new, [*keys, BUCKET], "full" if insert else "left")
    changed = F.col("_new").isNotNull() & (F.lit(update) | F.col("_old").isNull())

    def value(c: str):
        if c not in given:
            return F.col(c)
        fresh = F.col(f"_new_{c}")
        if c in history:
            said = F.coalesce(F.col(c), F.lit(""))
            repeated = (said == fresh) | said.endswith(F.concat(F.lit("; "), fresh))
            fresh = F.when(fresh.isNull() | repeated, F.col(c)).when(said == "", fresh).otherwise(F.concat_ws("; ", said, fresh))
        return F.when(changed, fresh).otherwise(F.col(c)).alias(c)

    _write(both.select(*(F.col(c) if c in keys else value(c) for c in columns), BUCKET), path)
    return len(touched)
