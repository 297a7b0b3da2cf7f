"""Connected components as an iterated DataFrame plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.plans.scratch import materialise, remove


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Rows (node, component) of all nodes with an edge; a component is named by its smallest node.

    Alternates two steps until all nodes point straight at their component's smallest: every node hands its smallest neighbour to its
    larger neighbours, then to its smaller ones. The number of rounds grows with the logarithm of
    the longest path. Each round is written to the shared folder, which keeps plans short and the
    work safe when executors go. Edges with a null end, loops and repeated edges are allowed. A node
    with very many neighbours takes part in one aggregation with partial sums and in one join that
    adaptive execution can split. Joins are merge joins at every size, as a side that is small on disk may
    be large in memory, and a broadcast of it passes through the driver in each round. Without edges the result is empty.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    state = materialise(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    for _ in range(most_rounds):
        if _settled(state):
            break
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first, so that both sides of the join are plain shuffles, which adaptive execution splits at hubs
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-least")
        large = materialise(both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc-large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        before, state = state, materialise(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct(), "cc")
        remove(before, least, large, low)
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    roots = state.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, and none that has one itself."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 or (up = 1 and down = 1)").isEmpty()
