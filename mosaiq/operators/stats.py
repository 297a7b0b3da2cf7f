"""Measures of objects and channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values up to this count as empty.
LEAST = 1e-16


def percentiles(image: DataFrame, q: list[float], by: str = "c", value: str = "value", exact: bool = True) -> DataFrame:
    """Nearest-rank percentiles of the values above 0 for each channel, as columns p0, p1, ...; 0 where a channel has none.

    Values are counted first and the counts ranked, so what is ordered is the distinct values of a
    channel, not its pixels. ``exact=False`` uses a sketch of bounded size.
    """
    channels = image.select(by).distinct()
    shown = image.where(F.col(value) > LEAST)
    if not exact:
        found = shown.groupBy(by).agg(*[F.percentile_approx(value, x / 100).cast("double").alias(f"p{i}") for i, x in enumerate(q)])
    else:
        counts = shown.groupBy(by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
        upto = Window.partitionBy(by).orderBy("v")
        ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
        at = lambda x: F.bround(F.lit(x / 100) * (F.col("all") - 1)).cast("long")
        found = ranked.groupBy(by).agg(*[F.min(F.when(F.col("upto") > at(x), F.col("v"))).alias(f"p{i}") for i, x in enumerate(q)])
    return channels.join(found, by, "left").na.fill(0.0, [f"p{i}" for i in range(len(q))])


def measure(image: DataFrame, labels: DataFrame, axes: list[str], by: list[str] | None = None, value: str = "value") -> DataFrame:
    """label and area, mean, sum, min, max, stddev of the values under each object; ``by`` adds keys such as the channel or the region.

    The labels have no channel axis: each channel is joined to the same label pixels.
    """
    named = labels.where(F.col("label") > 0).select(*axes, "label")
    joined = image.join(named, axes)
    v = F.col(value).cast("double")
    return joined.groupBy("label", *(by or [])).agg(
        F.count("*").alias("area"), F.avg(v).alias("mean"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_pop(v).alias("deviation")
    )
