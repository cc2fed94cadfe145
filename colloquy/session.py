"""The session that the engine is made for; a cluster's own settings win."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.io.compression.codec": "zstd",
}


def session(app: str = "colloquy", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import the package: where they do not find it by their path, it is sent to them once."""
    root = Path(__file__).resolve().parent.parent
    on_path = {Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    sc = spark.sparkContext
    if root in on_path or getattr(sc, "_colloquy_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="colloquy-"))
    with zipfile.ZipFile(folder / "colloquy.zip", "w") as z:
        for p in sorted((root / "colloquy").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(folder / "colloquy.zip"))
    sc._colloquy_shipped = True
