"""What several operators share: table access, folds, bounded training samples."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.plans.scratch import materialise
from mosaiq.plans.ship import ship

#: Upper-case letters that the contracts lower; other letters stay.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return a worker's unused memory to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns as c0, c1, ..., which clash with nothing an operator adds, and the new name of each."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def own_names(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns under the names they came with, and no others."""
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(
    documents: DataFrame,
    labels: DataFrame,
    label: str,
    most: int,
    total_chars: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> list[tuple[str, int]]:
    """(text, label) of at most ``most`` labelled rows outside the held-out fold.

    The ids are picked on the small label table by hash order, all labels at one rate, so that their
    shares do not depend on the size of the table, and that the documents are only
    filtered by a broadcast of at most that many ids. Texts of every length are learned from: in hash
    order, up to and with the text that reaches ``total_chars``, which bounds the driver's memory.
    Null labels and ids are ignored; of several labels of one id the largest counts.
    """
    known = (
        labels.select(F.col(id_col).alias("k"), F.col(label).cast("int").alias("y"))
        .where(F.col("k").isNotNull() & F.col("y").isNotNull() & (fold(F.col("k"), 5) != 0))
        .groupBy("k")
        .agg(F.max("y").alias("y"))
    )
    picked = known.where(F.col("y").isin(0, 1)).orderBy(F.xxhash64("k"), "k").limit(most)
    found = (
        documents.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
        .where(F.col("t").isNotNull())
        .join(F.broadcast(picked), "k")
        .groupBy("k")
        .agg(F.min("t").alias("t"), F.max("y").alias("y"))
    )
    found = materialise(found.withColumn("h", F.xxhash64("k")), "sample")
    before, last = 0, None
    for r in found.select("k", "h", F.length("t").alias("n")).sort("h", "k").collect():
        if before >= total_chars:
            break
        before, last = before + r["n"], r
    within = (F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("k") <= last["k"]) if last else F.lit(False)
    rows = found.where(within).select("k", "t", "y").collect()
    return [(r["t"], r["y"]) for r in sorted(rows, key=lambda r: str(r["k"]))]
