"""Materialisation points that survive the loss of executors.

Intermediate tables that are read more than once, or whose lineage must be cut, are
written as Parquet below the folder that the cluster names in ``spark.checkpoint.dir``.
Only where that setting is absent and Spark runs in one process (tests) a folder of our own is used.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from mosaiq.plans.ship import ship

_LOCAL_DEFAULT = "/tmp/checkpoints"
_runs: dict[str, str] = {}
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, with its file system's scheme, as Spark itself resolves it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found or _LOCAL_DEFAULT)
    return str(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where)).rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below :func:`shared_dir`, removed when Python exits."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_dir(spark)}/mosaiq-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _runs[app])
    return _runs[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone at exit; the folder is then left to the cluster's own cleaning
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written to."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and return the written table."""
    spark = df.sparkSession
    ship(spark)
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def remove(*tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads; others are left alone."""
    for t in tables:
        if path := getattr(t, "scratch_path", None):
            _remove(t.sparkSession, path)


@contextmanager
def rounds(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialised within are deleted at its end, but for those passed through what it yields."""
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.scratch_path)
        return table

    own: list[str] = []
    _open.append(own)
    try:
        yield keep
    finally:
        _open.remove(own)
        for path in own:
            if path not in kept:
                _remove(spark, path)
            elif _open:
                _open[-1].append(path)


@contextmanager
def tracked() -> Iterator[list[str]]:
    """Yields the list of what is materialised within, for :func:`drop`."""
    own: list[str] = []
    _open.append(own)
    try:
        yield own
    finally:
        _open.remove(own)


def drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _remove(spark, path)
