"""Regions over time and levels that follow writes, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.pyramid import coarsen


def windowed_measure(stream: DataFrame, time: str, size: str, value: str, keys: list[str], slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tiles of the time axis: count, mean and sum of a value per key and window; rows later than ``late`` are left out.

    State is kept per key and open window only, and dropped when the watermark passes.
    """
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, size, slide or size), *keys)
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *keys, "n", "mean", "total")
    )


def refresh_batch(fine: Callable[[], DataFrame], write: Callable[[DataFrame], None], factor: dict[str, int], sizes: dict[str, int], how: str = "mean", dtype: str | None = None):
    """A ``foreachBatch`` function: for pixels written in a batch, makes the blocks of the next level that hold them again.

    ``fine`` gives the finer level as it is now, ``write`` replaces the given blocks of the coarser one.
    """

    def run(batch: DataFrame, _: int) -> None:
        axes = list(factor)
        touched = batch.select(*[F.floor(F.col(a) / factor[a]).cast("int").alias(f"__{a}") for a in axes]).distinct()
        current = fine()
        held = current.select("*", *[F.floor(F.col(a) / factor[a]).cast("int").alias(f"__{a}") for a in axes]).join(touched, [f"__{a}" for a in axes], "left_semi")
        write(coarsen(held.select(*current.columns), factor, sizes, how, dtype))

    return run
