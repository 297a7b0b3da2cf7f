"""Label images as rows (coordinates, label); label 0 is background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.regions import span
from mosaiq.plans.numbering import numbered

#: Largest id of the label types; Spark has no unsigned types, so limits are checked.
LIMITS = {"uint8": 2**8 - 1, "uint16": 2**16 - 1, "uint32": 2**32 - 1, "int8": 2**7 - 1, "int16": 2**15 - 1, "int32": 2**31 - 1, "int64": 2**63 - 1}


def bounding_boxes(labels: DataFrame, axes: list[str], pixel: dict[str, float] | None = None) -> DataFrame:
    """label, name, and one world span per axis for each object (one pass, partial sums per task)."""
    pixel = pixel or {}
    boxes = labels.where(F.col("label") > 0).groupBy("label").agg(*[f(F.col(a)).alias(f"{a}_{n}") for a in axes for n, f in (("low", F.min), ("high", F.max))])
    spans = [span(F.col(f"{a}_low") * pixel.get(a, 1.0), (F.col(f"{a}_high") - F.col(f"{a}_low") + 1) * pixel.get(a, 1.0)).alias(a) for a in axes]
    return boxes.select(F.col("label").cast("long").alias("label"), F.col("label").cast("string").alias("name"), *spans)


def offset(label: Column, by: Column) -> Column:
    """Ids moved up, background kept."""
    return F.when(label > 0, label + by).otherwise(label)


def checked_offset(label: Column, block: int, index: Column, dtype: str = "uint32") -> Column:
    """Ids moved into the block of their tile; an id above the block or the type's limit is an error."""
    moved = label + index * block
    bad = (label > block) | (moved > LIMITS[dtype])
    return F.when(label <= 0, label).when(bad, F.raise_error(F.lit("an id does not fit its block or type")).cast("long")).otherwise(moved)


def unique_labels(label: Column, block: int, index: Column, back: bool = False) -> Column:
    """Ids made unique across units, or the inverse."""
    shift = -index * block if back else index * block
    return F.when(label > 0, label + shift).otherwise(label)


def relabel(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ids replaced where ``mapping`` (old, new) has them."""
    named = mapping.select(F.col("old").alias("label"), F.col("new").alias("__new"))
    return labels.join(named, "label", "left").withColumn("label", F.coalesce("__new", "label")).drop("__new").select(*labels.columns)


def relabel_sequential(labels: DataFrame, unit_rank: Column, mapping: DataFrame | None = None) -> DataFrame:
    """(old, new): ids 1..N by the first unit that holds them, ascending within a unit.

    ``unit_rank`` numbers the write units row by row. With ``mapping`` (old, new) several old ids are
    one object, placed by its earliest (unit, old id). Only one row per object is ever ordered.
    """
    seen = labels.where(F.col("label") > 0).select(F.col("label").alias("old"), unit_rank.alias("unit")).groupBy("old").agg(F.min("unit").alias("unit"))
    if mapping is not None:
        seen = seen.join(mapping.select("old", F.col("new").alias("root")), "old", "left").withColumn("root", F.coalesce("root", "old"))
    else:
        seen = seen.withColumn("root", F.col("old"))
    places = seen.groupBy("root").agg(F.min(F.struct("unit", "old")).alias("place"))
    return seen.join(numbered(places, ["place"], "new"), "root").select("old", "new")


def overlap_iou(left: DataFrame, right: DataFrame, axes: list[str]) -> DataFrame:
    """(a, b, shared, iou) of ids of two label images; areas count the whole images without background."""
    a = left.where(F.col("label") > 0).select(*axes, F.col("label").alias("a"))
    b = right.where(F.col("label") > 0).select(*axes, F.col("label").alias("b"))
    shared = a.join(b, axes).groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = shared.join(a.groupBy("a").agg(F.count("*").alias("area_a")), "a").join(b.groupBy("b").agg(F.count("*").alias("area_b")), "b")
    return out.select("a", "b", "shared", (F.col("shared") / (F.col("area_a") + F.col("area_b") - F.col("shared"))).alias("iou"))
