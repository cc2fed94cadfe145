"""Versioned tables: publish, validate, swap, roll back, clear and restore, and snapshots of several tables.

A version is a folder of its own; which one counts is named by the pointer with the highest number, and a pointer
appears by one rename. So readers see the old version or the new one, whatever fails in between.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which all executors share; a session on one machine without it gets a folder of its own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="colloquy-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for what is read more than once."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """The few file operations that Spark's writers lack, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        """Fails if the new path exists."""
        fs, p = self._at(old)
        _, q = self._at(new)
        fs.mkdirs(q.getParent())
        if fs.exists(q) or not fs.rename(p, q):
            raise FileExistsError(new)

    def write(self, path: str, text: str) -> None:
        """The whole text under a new path, by a rename."""
        fs, p = self._at(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(p)
        out.write(bytearray(text.encode()))
        out.close()
        self.rename(p.toString(), path)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


def facts(df: DataFrame) -> dict:
    """Rows and an order-free digest of a table."""
    body = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)) if df.columns else F.lit(0).cast("long")
    r = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(body.cast("decimal(38,0)")), F.lit(0)).alias("digest")).first()
    return {"rows": r["rows"], "digest": str(r.digest)}


class Store:
    """Named versioned tables below a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark)

    def _pointers(self, name: str) -> list[str]:
        return [n for n in self.files.names(f"{self.root}/{name}/current") if n.isdigit()]

    def current(self, name: str) -> dict | None:
        """What the last pointer says: version, rows, digest, settings; None without one."""
        last = max(self._pointers(name), default=None, key=int)
        return None if last is None else json.loads(self.files.read(f"{self.root}/{name}/current/{last}"))

    def is_cold(self, *names: str) -> bool:
        """Whether any of the tables was never published, so that a run starts afresh."""
        return any(self.current(n) is None for n in names)

    def _point(self, name: str, what: dict) -> None:
        number = max(map(int, self._pointers(name)), default=0) + 1
        self.files.write(f"{self.root}/{name}/current/{number:08d}", json.dumps(what, sort_keys=True))

    def publish(self, name: str, df: DataFrame, valid: Callable[[DataFrame], bool] | None = None, **settings) -> dict:
        """Write a new version, read it back, and make it the current one if it is valid; a version that is not goes again, and the old one stays."""
        version = uuid.uuid4().hex
        path = f"{self.root}/{name}/data/{version}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        if valid is not None and not valid(back):
            self.files.remove(path)
            raise ValueError(f"the new version of {name} is not valid")
        what = {"version": version, "schema": df.schema.jsonValue(), "settings": settings, "before": (self.current(name) or {}).get("version"), **facts(back)}
        self._point(name, what)
        return what

    def read(self, name: str) -> DataFrame:
        from pyspark.sql.types import StructType

        what = self.current(name)
        if what is None:
            raise FileNotFoundError(f"{self.root}/{name}")
        return self.spark.read.schema(StructType.fromJson(what["schema"])).parquet(f"{self.root}/{name}/data/{what['version']}")

    def verify(self, *names: str) -> None:
        """Raise an error where a table is missing, or its rows or digest are not those of its pointer."""
        for name in names:
            found = facts(self.read(name))
            if found != {k: self.current(name)[k] for k in found}:
                raise ValueError(f"{name} does not match its manifest")

    def rollback(self, name: str) -> None:
        """Point to the version before the current one."""
        before = (self.current(name) or {}).get("before")
        for pointer in sorted(self._pointers(name), key=int, reverse=True):
            what = json.loads(self.files.read(f"{self.root}/{name}/current/{pointer}"))
            if what["version"] == before:
                return self._point(name, what)
        raise ValueError(f"{name} has no version before")

    def clear(self, name: str) -> None:
        """An empty version with the same columns."""
        self.publish(name, self.read(name).limit(0))

    def vacuum(self, name: str) -> None:
        """Delete all versions but the current one and the one before."""
        now = self.current(name) or {}
        for version in self.files.names(f"{self.root}/{name}/data"):
            if version not in (now.get("version"), now.get("before")):
                self.files.remove(f"{self.root}/{name}/data/{version}")

    # ---- keyed tables --------------------------------------------------------------------

    def update(self, name: str, rows: DataFrame, key: str) -> None:
        """Replace the rows of known keys; new keys are not added."""
        old = self.read(name)
        known = rows.join(old.select(key), key, "left_semi")
        self.publish(name, old.join(known.select(key), key, "left_anti").unionByName(known.select(*old.columns)))

    def delete(self, name: str, keys: DataFrame, key: str) -> None:
        self.publish(name, self.read(name).join(keys.select(key), key, "left_anti"))

    # ---- snapshots -----------------------------------------------------------------------

    def snapshot(self, path: str, names: list[str], **settings) -> None:
        """Copies of the current versions with a manifest of rows, digests and settings; appears by one rename and never replaces one."""
        if self.files.exists(path):
            raise FileExistsError(path)
        self.verify(*names)
        part = f"{path}.{uuid.uuid4().hex}"
        for name in names:
            self.read(name).write.parquet(f"{part}/{name}")
        tables = {n: {k: self.current(n)[k] for k in ("rows", "digest", "schema")} for n in names}
        self.files.write(f"{part}/manifest.json", json.dumps({"settings": settings, "tables": tables}, sort_keys=True))
        self.files.rename(part, path)

    def restore(self, path: str, **settings) -> list[str]:
        """Publish the tables of a snapshot, if it is whole and was taken with these settings; returns their names."""
        from pyspark.sql.types import StructType

        if not self.files.exists(f"{path}/manifest.json"):
            raise ValueError(f"{path} is not a whole snapshot")
        manifest = json.loads(self.files.read(f"{path}/manifest.json"))
        other = {k for k in settings.keys() | manifest["settings"].keys() if settings.get(k) != manifest["settings"].get(k)}
        if other:
            raise ValueError(f"{path} was taken with other settings: {sorted(other)}")
        read = {n: self.spark.read.schema(StructType.fromJson(t["schema"])).parquet(f"{path}/{n}") for n, t in manifest["tables"].items()}
        for n, df in read.items():
            if facts(df) != {k: manifest["tables"][n][k] for k in ("rows", "digest")}:
                raise ValueError(f"{n} in {path} does not match its manifest")
        for n, df in read.items():
            self.publish(n, df)
        return sorted(read)
