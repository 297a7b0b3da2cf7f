"""Joining objects that tiles cut apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.labels import relabel_sequential
from mosaiq.plans.graph import connected_components
from mosaiq.plans.scratch import materialise


def stitch(predicted: DataFrame, axes: list[str], block: int, threshold: float = 0.3, limit: int = 2**32 - 1, tile: str = "tile") -> DataFrame:
    """One label image from overlapping tiles' predictions.

    ``predicted`` has (tile, coordinates, label, core): every pixel of the grown tile, and whether it
    is in the tile's core. Ids are moved to the tile's block ``(tile + 1) * block``; two tiles' ids whose
    pixels in common reach ``threshold`` of their union there are one object. The result holds the
    cores' pixels (a later tile wins) with ids 1..N by first tile. One equi-join on coordinates finds
    the pairs and their overlap; tiles on the same pixels are few, so it stays linear.
    """
    top = predicted.agg(F.max(tile), F.max("label")).first()
    if top[0] is not None and (top[1] > block or (top[0] + 2) * block - 1 > limit):
        raise ValueError("ids do not fit their blocks or the label type")
    bank = predicted.withColumn("id", F.when(F.col("label") > 0, F.col("label") + (F.col(tile) + 1) * block).otherwise(0).cast("long"))
    bank = materialise(bank.select(tile, *axes, "id", "core"), "stitch-bank")
    left = bank.select(F.col(tile).alias("i"), *axes, F.col("id").alias("a"))
    right = bank.select(F.col(tile).alias("j"), *axes, F.col("id").alias("b"))
    common = left.join(right, axes).where(F.col("i") < F.col("j"))
    by_pair = materialise(common.groupBy("i", "j", "a", "b").agg(F.count("*").alias("n")), "stitch-pairs")
    area_a = by_pair.where("a > 0").groupBy("i", "j", "a").agg(F.sum("n").alias("na"))
    area_b = by_pair.where("b > 0").groupBy("i", "j", "b").agg(F.sum("n").alias("nb"))
    pairs = by_pair.where("a > 0 and b > 0").join(area_a, ["i", "j", "a"]).join(area_b, ["i", "j", "b"])
    same = pairs.where(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")) >= threshold).select("a", "b")
    roots = connected_components(same).select(F.col("node").alias("old"), F.col("component").alias("new"))
    core = bank.where("core").groupBy(*axes).agg(F.max_by("id", tile).alias("label"), F.max(tile).alias("__unit"))
    numbers = relabel_sequential(core, F.col("__unit"), roots)
    named = core.join(numbers.select(F.col("old").alias("label"), "new"), "label", "left")
    return named.select(*axes, F.coalesce("new", F.lit(0)).cast("long").alias("label"))
