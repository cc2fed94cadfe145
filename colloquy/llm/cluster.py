"""Shared folders, bounded broadcasts and partition counts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import types as T

#: Bytes of an Arrow batch between Spark and a Python worker; without a bound it is 10,000 rows, however long their texts.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on bounds the bytes of Arrow batches, unless a smaller bound holds already."""
    conf = df.sparkSession.conf
    now = conf.get(BATCH_SETTING).lower().removesuffix("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def filtered(df: DataFrame, column: str, run: Callable[[str], Callable]) -> DataFrame:
    """The rows of df that the Arrow function run(name) lets through, where name is that of `column` inside: columns go by number there, so they may have any name."""
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)])
    return bounded_batches(df).toDF(*inner.names).mapInArrow(run(f"c{df.columns.index(column)}"), inner).toDF(*df.columns)


_made: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share: spark.checkpoint.dir. Where that is unset a session on one machine (as in tests) gets a folder of its own, any other an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="colloquy-")
        sc.setCheckpointDir(base)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path: cuts its lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that shared_dir has given."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    if path in _made:
        _made.remove(path)


def clean(spark: SparkSession) -> int:
    """Delete all that this process has written to the shared folder; results not computed by then are lost. Returns how many paths went."""
    paths = list(_made)
    for path in paths:
        remove(spark, path)
    return len(paths)


def partitions(df: DataFrame) -> int:
    """As many as a shuffle has, and at least as many as the input has."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def running(*keys: str, by: str) -> WindowSpec:
    """The rows of a key up to the current one."""
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def columns_but(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
