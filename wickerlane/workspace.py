"""Scratch space that every executor can reach, and helpers for tables written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []
_TABLES: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def _archive() -> str:
    package = Path(__file__).resolve().parent
    return shutil.make_archive(f"{tempfile.mkdtemp(prefix='wickerlane-')}/wickerlane", "zip", package.parent, package.name)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that none needs it installed."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        spark.sparkContext.addPyFile(_archive())


@cache
def _own_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="wickerlane-")


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local one only where that is unset in a local session (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
    return (named or _own_root()).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver ends."""
    path = f"{shared_root(spark)}/wickerlane/{name}-{uuid.uuid4().hex}"
    _at_exit()
    _MADE.append((spark, path))
    return path


def catalogued(spark: SparkSession, table: str) -> str:
    """The name of a table that the catalog is to forget when the driver ends; its files stay."""
    _at_exit()
    _TABLES.append((spark, table))
    return table


@cache
def _at_exit() -> None:
    atexit.register(_sweep)


def filesystem(spark: SparkSession, path: str):
    """Hadoop file system and path object, so that any storage the cluster knows will do."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    fs, target = filesystem(spark, path)
    fs.delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Paths below a folder (or the file itself), sorted."""
    fs, target = filesystem(spark, path)
    if not fs.exists(target):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(target))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to shared storage and read back: cuts lineage and survives a lost executor.

    The shuffle files of the write are removed when it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Remove what ``materialize`` wrote for a table that is read no more."""
    spark, root = df.sparkSession, shared_root(df.sparkSession)
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if f"{root}/wickerlane/".removeprefix("file://").removeprefix("file:") in f:
            remove(spark, f)


def _sweep() -> None:
    for spark, table in _TABLES:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:
            break
    for spark, path in _MADE:
        try:
            remove(spark, path)
        except Exception:
            return
