"""Small files on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _at(spark, path)
    return system.exists(where)


def read_text(spark: SparkSession, path: str) -> str:
    """A whole file; metadata, not data. Spark's own readers pass over names that begin with a dot."""
    where, system = _at(spark, path)
    source = system.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where, system = _at(spark, path)
    out = system.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def delete(spark: SparkSession, path: str) -> None:
    where, system = _at(spark, path)
    system.delete(where, True)
