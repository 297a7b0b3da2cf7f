"""Numbers along an order without sorting a whole table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.plans.scratch import materialise


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """``rows`` with a long column ``name``, which replaces one of that name: first, first + 1, ... by the columns ``order``, nulls first.

    Rows are dealt into ranges of the order and numbered within each; a range's numbers go on from the
    counts of the earlier ranges, one row for each range. Rows that are equal in ``order`` lie in one
    range and are numbered in any order. An empty table gives an empty result.
    """
    dealt = materialise(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "numbered")
    earlier = Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(F.col("__p").alias("__q")).agg(F.count("*").alias("__many"))
    counts = counts.select("__q", F.coalesce(F.sum("__many").over(earlier), F.lit(0)).alias("__before"))
    ranked = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    # one row for each range, as many as the session's shuffle partitions at most
    placed = ranked.join(F.broadcast(counts), F.col("__p") == F.col("__q"))
    return placed.select(*[c for c in rows.columns if c != name], (F.col("__before") + F.col("__n") - 1 + first).cast("long").alias(name))
