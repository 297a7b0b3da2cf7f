"""Array kernels over tiles: map, reduce and detect with functions of the user, and box suppression."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators.spatial import iou, overlap_pairs
from mosaiq.plans.graph import connected_components
from mosaiq.plans.numbering import numbered
from mosaiq.plans.scratch import materialise, remove
from mosaiq.plans.ship import ship

#: Rounds over all open overlaps before boxes are suppressed by component.
ROUNDS = 8


def dense(rows: pd.DataFrame, axes: list[str], first: list[int], shape: list[int], value: str) -> np.ndarray:
    """The pixels of a tile as an array; pixels that are not there are 0."""
    out = np.zeros(shape, rows[value].dtype)
    if len(rows):
        out[tuple(rows[a].to_numpy() - f for a, f in zip(axes, first, strict=True))] = rows[value].to_numpy()
    return out


def _tiled(image: DataFrame, tiles: DataFrame, axes: list[str], key: str, cell: int) -> DataFrame:
    """Pixels with each tile that reads them (columns <axis>_start, <axis>_stop: the read box), joined by coarse cells; tiles without pixels keep one row of nulls."""
    cells, cut = [], tiles
    for a in axes[-2:]:
        cut = cut.withColumn(f"__c_{a}", F.explode(F.sequence(F.floor(F.col(f"{a}_start") / cell), F.floor((F.col(f"{a}_stop") - 1) / cell))))
        cells.append(f"__c_{a}")
    marked = image.select("*", *[F.floor(F.col(a) / cell).alias(f"__c_{a}") for a in axes[-2:]])
    hold = F.lit(True)
    for a in axes:
        hold &= (F.col(a) >= F.col(f"{a}_start")) & (F.col(a) < F.col(f"{a}_stop"))
    read = marked.join(cut, cells).where(hold).drop(*cells)
    empty = tiles.join(read.select(key).distinct(), key, "left_anti")
    return read.unionByName(empty, allowMissingColumns=True)


def map_tiles(image: DataFrame, tiles: DataFrame, func: Callable[[np.ndarray], np.ndarray], axes: list[str], key: str = "tile_index", value: str = "value", out_type: str = "double", cell: int = 256) -> DataFrame:
    """Apply ``func`` to each tile's array and return the pixels of its core.

    Tiles have ``<axis>_start/_stop`` (what is read, with any halo) and may have ``<axis>_core_start/
    _core_stop`` (what is written). Where cores overlap, the tile with the larger key wins.
    """
    ship(image.sparkSession)
    cored = all(f"{a}_core_start" in tiles.columns for a in axes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows.iloc[0]
        first = [int(head[f"{a}_start"]) for a in axes]
        shape = [int(head[f"{a}_stop"]) - f for a, f in zip(axes, first, strict=True)]
        out = np.asarray(func(dense(rows.dropna(subset=axes).astype({a: int for a in axes}), axes, first, shape, value)))
        if out.shape != tuple(shape):
            raise ValueError(f"the function returned shape {out.shape} for {tuple(shape)}")
        at = np.indices(out.shape).reshape(len(axes), -1)
        made = pd.DataFrame({a: at[i] + first[i] for i, a in enumerate(axes)} | {value: out.reshape(-1), key: head[key]})
        if cored:
            for a in axes:
                made = made[(made[a] >= head[f"{a}_core_start"]) & (made[a] < head[f"{a}_core_stop"])]
        return made

    schema = ", ".join(f"{a} int" for a in axes) + f", {value} {out_type}, {key} long"
    pixels = _tiled(image.select(*axes, value), tiles, axes, key, cell).groupBy(key).applyInPandas(run, schema)
    return pixels.groupBy(*axes).agg(F.max_by(value, key).alias(value))


def segment(image: DataFrame, tiles: DataFrame, func: Callable[[np.ndarray], np.ndarray], axes: list[str], block: int, stitched: bool = False, threshold: float = 0.3, key: str = "tile_index", value: str = "value") -> DataFrame:
    """(coordinates, label) from ``func``, which labels the objects of a tile's array with 1, 2, ...

    Ids are moved to the tile's block of ``block`` numbers, so they are unique; more objects than that are an
    error. With ``stitched`` the objects that a border between tiles cuts apart become one, numbered 1..N.
    """
    ship(image.sparkSession)
    names = [f"{a}_{part}" for a in axes for part in ("start", "stop", "core_start", "core_stop")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows.iloc[0]
        first = [int(head[f"{a}_start"]) for a in axes]
        shape = [int(head[f"{a}_stop"]) - f for a, f in zip(axes, first, strict=True)]
        out = np.asarray(func(dense(rows.dropna(subset=axes).astype({a: int for a in axes}), axes, first, shape, value)))
        if out.shape != tuple(shape) or (out.size and out.max() > block):
            raise ValueError("the function returned another shape, or more objects than a block holds")
        at = np.indices(out.shape).reshape(len(axes), -1)
        made = pd.DataFrame({a: at[i] + first[i] for i, a in enumerate(axes)} | {"label": out.reshape(-1).astype(np.int64), "tile": head[key]})
        made["core"] = True
        for a in axes:
            made["core"] &= (made[a] >= head[f"{a}_core_start"]) & (made[a] < head[f"{a}_core_stop"])
        return made

    read = _tiled(image.select(*axes, value), tiles.select(key, *names), axes, key, 256)
    predicted = read.groupBy(key).applyInPandas(run, ", ".join(f"{a} int" for a in axes) + ", label long, tile long, core boolean")
    if stitched:
        from mosaiq.operators.stitch import stitch

        return stitch(predicted, axes, block, threshold)
    moved = F.when(F.col("label") > 0, F.col("label") + F.col("tile") * block).otherwise(0).cast("long")
    return predicted.where("core").groupBy(*axes).agg(F.max_by(moved, "tile").alias("label"))


def segment_masked(image: DataFrame, objects: DataFrame, func: Callable[[np.ndarray], np.ndarray], axes: list[str], block: int, value: str = "value") -> DataFrame:
    """(coordinates, label) of what ``func`` finds within each object: it gets the object's box with other pixels 0,
    and what it labels outside the object is not written. Ids are moved to the object's block."""
    ship(image.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = [int(rows[a].min()) for a in axes]
        shape = [int(rows[a].max()) - f + 1 for a, f in zip(axes, first, strict=True)]
        found = np.asarray(func(dense(rows.fillna({value: 0}), axes, first, shape, value)))
        if found.shape != tuple(shape) or (found.size and found.max() > block):
            raise ValueError("the function returned another shape, or more objects than a block holds")
        own = found[tuple(rows[a].to_numpy() - f for a, f in zip(axes, first, strict=True))].astype(np.int64)
        return pd.DataFrame({a: rows[a] for a in axes} | {"label": np.where(own > 0, own + rows["__object"].iloc[0] * block, 0)})

    read = objects.where("label <> 0").select(*axes, F.col("label").alias("__object")).join(image.select(*axes, value), axes, "left")
    return read.groupBy("__object").applyInPandas(run, ", ".join(f"{a} int" for a in axes) + ", label long")


def reduce_tiles(image: DataFrame, tiles: DataFrame, func: Callable[[np.ndarray], dict | list[dict]], schema: str, axes: list[str], key: str = "tile_index", value: str = "value", cell: int = 256) -> DataFrame:
    """One or more rows of ``schema`` per tile from ``func`` of its array, with the tile's key and a row number."""
    ship(image.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows.iloc[0]
        first = [int(head[f"{a}_start"]) for a in axes]
        shape = [int(head[f"{a}_stop"]) - f for a, f in zip(axes, first, strict=True)]
        made = func(dense(rows.dropna(subset=axes).astype({a: int for a in axes}), axes, first, shape, value))
        made = made if isinstance(made, list) else [made]
        return pd.DataFrame([{key: head[key], "row": i} | m for i, m in enumerate(made)], columns=[key, "row", *names])

    names = [part.split()[0] for part in schema.split(",")]
    return _tiled(image.select(*axes, value), tiles, axes, key, cell).groupBy(key).applyInPandas(run, f"{key} long, row int, {schema}")


def suppress(boxes: DataFrame, axes: list[str], threshold: float = 0.5, score: str | None = "score", group: list[str] | None = None, cell: dict[str, float] | None = None, key: tuple[str, str] = ("tile", "row")) -> DataFrame:
    """Greedy suppression: best first by (score, tile, row), a box goes when it overlaps a kept one of its group by ``threshold`` or more.

    Suppression acts along such overlaps only, so boxes without one stay without further ado. Of the others those without a better
    one stay and those that overlap them go, in ROUNDS rounds over the overlaps that are still open; what chains
    of overlaps leave open after these is chosen greedily within connected components. Without a score the volume ranks; boxes whose
    score is null or no number come last. Kept boxes get ids 1..N by (tile, row).
    """
    ship(boxes.sparkSession)
    group, cell = group or [], cell or {a: 64.0 for a in axes}
    volume = F.lit(1.0)
    for a in axes:
        volume = volume * (F.col(f"{a}_stop") - F.col(f"{a}_start"))
    worth = (F.col(score) if score else volume).cast("double")
    ranked = boxes.withColumn("__rank", F.struct(F.when(F.isnan(worth), None).otherwise(-worth).alias("s"), *key)).withColumn("__id", F.xxhash64(*key))
    ranked = ranked.withColumn("__rank", F.struct(F.col("__rank.s").isNull().alias("last"), F.col("__rank.*")))
    same = F.lit(True)
    for g in group:
        same &= F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    compared = ranked.select("__id", "__rank", *group, *[f"{a}_{side}" for a in axes for side in ("start", "stop")])
    first = F.col("a.__rank") < F.col("b.__rank")
    sides = F.when(first, F.col("a.__id")).otherwise(F.col("b.__id")), F.when(first, F.col("b.__id")).otherwise(F.col("a.__id"))
    edges = overlap_pairs(compared, "__id", axes, cell, same).where(iou(axes) >= threshold)
    edges = materialise(edges.select(sides[0].alias("better"), sides[1].alias("worse")), "boxes-overlaps")
    gone: list[DataFrame] = []
    for _ in range(ROUNDS):
        if edges.isEmpty():
            break
        worse = edges.select(F.col("worse").alias("better")).hint("merge")
        lost = materialise(edges.join(worse, "better", "left_anti").select(F.col("worse").alias("__id")).distinct(), "boxes-lost")
        # an overlap with a box that stays goes too, as its other box is lost
        out = [lost.select(F.col("__id").alias(side)).hint("merge") for side in ("better", "worse")]
        before, edges = edges, materialise(edges.join(out[0], "better", "left_anti").join(out[1], "worse", "left_anti"), "boxes-overlaps")
        remove(before)
        gone.append(lost)
    if not edges.isEmpty():
        gone.append(_chosen_apart(ranked, edges, axes, threshold, group, key))
    left = ranked.join(reduce(DataFrame.unionByName, gone).hint("merge"), "__id", "left_anti") if gone else ranked
    return numbered(left.drop("__id", "__rank"), list(key), "id")


def _chosen_apart(ranked: DataFrame, edges: DataFrame, axes: list[str], threshold: float, group: list[str], key: tuple[str, str]) -> DataFrame:
    """(__id) of the boxes that go, chosen within each connected component of ``edges``."""
    components = materialise(connected_components(edges, "better", "worse"), "boxes-components")
    crowded = ranked.join(components.withColumnRenamed("node", "__id").hint("merge"), "__id")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__place", kind="stable").reset_index(drop=True)
        low, high = (rows[[f"{a}_{side}" for a in axes]].to_numpy(float) for side in ("start", "stop"))
        size = (high - low).prod(1)
        kept: list[int] = []
        for i in range(len(rows)):
            if kept:
                both = np.maximum(np.minimum(high[kept], high[i]) - np.maximum(low[kept], low[i]), 0).prod(1)
                alike = np.ones(len(kept), bool)
                for g in group:
                    alike &= (rows[g].iloc[kept].to_numpy() == rows[g].iloc[i]) | (pd.isna(rows[g].iloc[kept].to_numpy()) & pd.isna(rows[g].iloc[i]))
                if (alike & (both / (size[kept] + size[i] - both) >= threshold)).any():
                    continue
            kept.append(i)
        return rows.drop(index=kept)[["__id"]]

    place = F.row_number().over(Window.partitionBy("component").orderBy("__rank"))
    flat = crowded.select("component", "__id", place.alias("__place"), *group, *[f"{a}_{side}" for a in axes for side in ("start", "stop")])
    return materialise(flat.groupBy("component").applyInPandas(choose, "__id long"), "boxes-lost")


def detect(image: DataFrame, tiles: DataFrame, func: Callable[[np.ndarray], list[dict]], axes: list[str], most: int | None = None, score: bool = False, **kw) -> DataFrame:
    """Boxes that ``func`` finds at pixel offsets of each tile, in pixels of the image, after suppression.

    A found box is a dict of ``<axis>_start`` and ``<axis>_length`` for every axis, and ``score`` if
    told so. More than ``most`` boxes of a tile are an error, not a cut.
    """
    fields = [f"{a}_{n}" for a in axes for n in ("start", "length")] + (["score"] if score else [])

    def checked(patch: np.ndarray) -> list[dict]:
        found = func(patch)
        if not isinstance(found, list):
            raise TypeError("a detector returns a list of boxes")
        if most is not None and len(found) > most:
            raise ValueError(f"{len(found)} boxes in a tile, {most} at most")
        for box in found:
            if set(box) != set(fields):
                raise ValueError(f"a box has the fields {fields}")
            if any(box[f] is None or f.endswith("_length") and box[f] <= 0 for f in fields):
                raise ValueError("a box has bounds on every axis and a length above 0")
        return found

    found = reduce_tiles(image, tiles, checked, ", ".join(f"{f} double" for f in fields), axes, **kw)
    origins = tiles.select("tile_index", *[F.col(f"{a}_start").alias(f"__{a}") for a in axes])
    placed = found.join(origins, "tile_index").withColumnRenamed("tile_index", "tile")
    for a in axes:
        placed = placed.withColumn(f"{a}_start", F.col(f"__{a}") + F.col(f"{a}_start")).withColumn(f"{a}_stop", F.col(f"{a}_start") + F.col(f"{a}_length"))
    return placed.drop(*[f"__{a}" for a in axes], *[f"{a}_length" for a in axes])


def batched(frames: Iterator[np.ndarray], size: int) -> Iterator[np.ndarray]:
    """Stacks of up to ``size`` arrays, padded with zeros to the largest of the stack."""
    held: list[np.ndarray] = []

    def stacked() -> np.ndarray:
        shape = np.max([h.shape for h in held], axis=0)
        return np.stack([np.pad(h, [(0, n - m) for n, m in zip(shape, h.shape, strict=True)]) for h in held])

    for frame in frames:
        held.append(frame)
        if len(held) == size:
            yield stacked()
            held = []
    if held:
        yield stacked()
