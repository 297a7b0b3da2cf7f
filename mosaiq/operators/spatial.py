"""Joins of boxes that overlap.

Boxes are keyed by the cells of a grid they touch and joined by cell, an equi-join that shuffles like
any other and that adaptive execution can split. A pair that shares several cells is kept in one of
them, the cell of its common corner, so no ``distinct`` follows. The cell size should be near the
usual box size: a box is repeated once per cell it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(start: Column, stop: Column, cell: float) -> tuple[Column, Column]:
    """First and last cell of [start, stop)."""
    first = F.floor(start / cell)
    return first, F.greatest(F.ceil(stop / cell) - 1, first)


def _keyed(boxes: DataFrame, axes: list[str], cell: dict[str, float], tag: str) -> DataFrame:
    """Rows as a struct ``tag``, once for each cell; the bounds stand beside it, as they are read for every two boxes of a cell."""
    bounds = [F.col(f"{a}_{side}").alias(f"{tag}_{a}_{side}") for a in axes for side in ("start", "stop")]
    out = boxes.select(F.struct("*").alias(tag), *bounds)
    for a in axes:
        first, last = _cells(F.col(f"{tag}_{a}_start"), F.col(f"{tag}_{a}_stop"), cell[a])
        out = out.withColumn(f"{tag}_first_{a}", first).withColumn(f"__cell_{a}", F.explode(F.sequence(first, last)))
    return out


def overlap_join(left: DataFrame, right: DataFrame, axes: list[str], cell: dict[str, float], more: Column | None = None, large: bool = False) -> DataFrame:
    """Rows (a, b) of structs for all pairs that overlap on every axis. Columns ``<axis>_start``, ``<axis>_stop``, half-open and bounded.

    Where both sides are ``large``, neither is broadcast however small its files are.
    """
    keys = [f"__cell_{a}" for a in axes]
    other = _keyed(right, axes, cell, "b")
    pairs = _keyed(left, axes, cell, "a").join(other.hint("merge") if large else other, keys)
    hold = F.lit(True)
    for a in axes:
        hold &= (F.col(f"a_{a}_start") < F.col(f"b_{a}_stop")) & (F.col(f"b_{a}_start") < F.col(f"a_{a}_stop"))
        hold &= F.col(f"__cell_{a}") == F.greatest(F.col(f"a_first_{a}"), F.col(f"b_first_{a}"))
    return pairs.where(hold if more is None else hold & more).select("a", "b")


def overlap_pairs(boxes: DataFrame, key: str, axes: list[str], cell: dict[str, float], more: Column | None = None) -> DataFrame:
    """Each overlapping pair of one table once, with a's key below b's."""
    order = F.col(f"a.{key}") < F.col(f"b.{key}")
    return overlap_join(boxes, boxes, axes, cell, order if more is None else order & more, large=True)


def any_overlap(boxes: DataFrame, key: str, axes: list[str], cell: dict[str, float]) -> bool:
    return not overlap_pairs(boxes, key, axes, cell).limit(1).isEmpty()


def common_box(axes: list[str]) -> list[Column]:
    """The intersection's columns of a pair (a, b)."""
    out = []
    for a in axes:
        out += [F.greatest(f"a.{a}_start", f"b.{a}_start").alias(f"{a}_start"), F.least(f"a.{a}_stop", f"b.{a}_stop").alias(f"{a}_stop")]
    return out


def labels_compatible(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def touching_only(boxes: DataFrame, key: str, axes: list[str], cell: dict[str, float], grow: str) -> DataFrame:
    """Pairs (ka, kb) that overlap only once one axis is extended by a pixel.

    One join of the extended boxes finds them: the other axes of a pair are the same in both, so of its extended boxes those whose
    own ones overlap along ``grow`` drop out while they are compared, and no overlapping pair is written.
    """
    own = f"__{grow}_stop"
    grown = boxes.withColumn(own, F.col(f"{grow}_stop")).withColumn(f"{grow}_stop", F.col(f"{grow}_stop") + 1)
    apart = (F.col(f"a.{grow}_start") >= F.col(f"b.{own}")) | (F.col(f"b.{grow}_start") >= F.col(f"a.{own}"))
    return overlap_pairs(grown, key, axes, cell, apart).select(F.col(f"a.{key}").alias("ka"), F.col(f"b.{key}").alias("kb"))


def iou(axes: list[str]) -> Column:
    """Intersection over union of a pair (a, b)."""
    volume = lambda side: _product([F.col(f"{side}.{a}_stop") - F.col(f"{side}.{a}_start") for a in axes])
    both = _product([F.least(f"a.{a}_stop", f"b.{a}_stop") - F.greatest(f"a.{a}_start", f"b.{a}_start") for a in axes])
    return F.try_divide(both, volume("a") + volume("b") - both)


def _product(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out * p
    return out
