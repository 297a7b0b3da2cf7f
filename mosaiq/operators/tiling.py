"""Tiles of axes and images. Sizes are columns, so one plan tiles images of many shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.regions import AXES

TAILS = ("clip", "balance", "shift", "drop")


def axis_tiles(dim: Column, size: Column, stride: Column | None = None, tail: str = "clip") -> Column:
    """Array of (start, length) along an axis.

    The tile over the border is cut (``clip``), evened out with its neighbour (``balance``, without
    overlap only), moved back (``shift``) or left out (``drop``, an error if nothing stays).
    """
    if tail not in TAILS:
        raise ValueError(f"tail must be one of {TAILS}")
    if tail == "balance" and stride is not None:
        raise ValueError("balance needs tiles without overlap")
    dim, size = dim.cast("int"), size.cast("int")
    stride = size if stride is None else stride.cast("int")
    checked = F.when(dim < 1, F.raise_error(F.lit("an axis without pixels cannot be tiled")).cast("int"))
    checked = checked.when(stride < 1, F.raise_error(F.lit("a stride is at least 1")).cast("int")).otherwise(dim)
    starts = F.sequence(F.lit(0), checked - 1, stride)
    tile = lambda start, length: F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"))
    if tail == "clip":
        return F.transform(starts, lambda s: tile(s, F.least(size, dim - s)))
    if tail == "shift":
        return F.array_distinct(F.transform(starts, lambda s: tile(F.least(s, F.greatest(dim - size, F.lit(0))), F.least(size, dim))))
    if tail == "drop":
        kept = F.transform(F.filter(starts, lambda s: s + size <= dim), lambda s: tile(s, size))
        none = F.raise_error(F.lit("every tile is dropped: the axis is shorter than a tile")).cast("array<struct<start:int,length:int>>")
        return F.when(dim < size, none).otherwise(kept)
    last = F.floor((dim - 1) / size).cast("int")  # index of the last tile
    both = dim - (last - 1) * size
    half = F.floor((both + 1) / 2).cast("int")
    uneven = (dim % size != 0) & (last > 0)
    start = lambda s: F.when(uneven & (s == last * size), (last - 1) * size + half).otherwise(s)
    length = lambda s: F.when(uneven & (s == last * size), both - half).when(uneven & (s == (last - 1) * size), half).otherwise(F.least(size, dim - s))
    return F.transform(starts, lambda s: tile(start(s), length(s)))


def axis_blocks(dim: Column, many: int) -> Column:
    """Array of ``many`` (start, length) that differ by one pixel at most, the longer ones first."""
    base, rest = F.floor(dim / many).cast("int"), (dim % many).cast("int")
    made = F.transform(
        F.sequence(F.lit(0), F.lit(many - 1)),
        lambda i: F.struct((i * base + F.least(i, rest)).cast("int").alias("start"), (base + F.when(i < rest, 1).otherwise(0)).cast("int").alias("length")),
    )
    none = F.raise_error(F.lit("more blocks than pixels")).cast("array<struct<start:int,length:int>>")
    return F.when(dim < many, none).otherwise(made)


def cross(images: DataFrame, tiles: dict[str, Column], name: str | None = None) -> DataFrame:
    """One row per image and tile: all columns, ``tile_<axis>`` structs, tile_name and tile_index in t, z, y, x order."""
    axes = [a for a in AXES if a in tiles]
    out = images
    for a in axes:
        out = out.select("*", F.posexplode(tiles[a]).alias(f"__i_{a}", f"tile_{a}"))
    index = F.lit(0).cast("long")
    for a in axes:
        index = index * F.size(tiles[a]) + F.col(f"__i_{a}")
    label = F.concat_ws("_", *([F.lit(name)] if name else []), *[F.concat(F.lit(a), F.col(f"tile_{a}.start")) for a in axes])
    return out.withColumn("tile_name", label).withColumn("tile_index", index).drop(*[f"__i_{a}" for a in axes])


def by_grid(images: DataFrame, sizes: dict[str, int], strides: dict[str, int] | None = None, tail: str = "clip", name: str | None = None) -> DataFrame:
    """Tiles of images with columns ``size_<axis>``; an axis without a given size is one tile."""
    strides = strides or {}
    tiles = {}
    for a in (a for a in AXES if f"size_{a}" in images.columns):
        dim = F.col(f"size_{a}")
        size = F.lit(sizes[a]) if a in sizes else dim
        tiles[a] = axis_tiles(dim, size, F.lit(strides[a]) if a in strides else None, tail)
    return cross(images, tiles, name)


def by_blocks(images: DataFrame, many: dict[str, int], name: str | None = None) -> DataFrame:
    axes = [a for a in AXES if f"size_{a}" in images.columns]
    return cross(images, {a: axis_blocks(F.col(f"size_{a}"), many.get(a, 1)) for a in axes}, name)


def by_yx(images: DataFrame) -> DataFrame:
    """One plane per t and z."""
    return by_grid(images, {"t": 1, "z": 1})


def by_zyx(images: DataFrame, strict: bool = True) -> DataFrame:
    """One volume per t; strict images have a z axis of more than one pixel."""
    if strict:
        if "size_z" not in images.columns:
            raise ValueError("images have no z axis")
        images = images.withColumn("size_z", F.when(F.col("size_z") > 1, F.col("size_z")).otherwise(F.raise_error(F.lit("z has one plane only")).cast("int")))
    return by_grid(images, {"t": 1})


def by_storage_units(images: DataFrame, overlap: dict[str, int] | None = None) -> DataFrame:
    """Tiles on the grid of ``chunk_<axis>`` columns, each sharing ``overlap`` pixels with the next; the last are cut."""
    overlap = overlap or {}
    tiles = {
        a: axis_tiles(F.col(f"size_{a}"), F.col(f"chunk_{a}"), F.col(f"chunk_{a}") - overlap.get(a, 0)) for a in AXES if f"size_{a}" in images.columns
    }
    return cross(images, tiles)


def batches(units: DataFrame, index: str, size: int) -> DataFrame:
    """``batch`` and place in it for units numbered from 0."""
    return units.withColumn("batch", F.floor(F.col(index) / size).cast("long")).withColumn("place", (F.col(index) % size).cast("long"))


def tile_extents(tiles: DataFrame, axes: list[str], sizes: dict[str, int], margin: int = 0) -> DataFrame:
    """What each tile writes (``<axis>_core_start/_core_stop``) and, grown by a margin within the image, reads (``<axis>_start/_stop``)."""
    for a in axes:
        first, stop = F.col(f"tile_{a}.start"), F.col(f"tile_{a}.start") + F.col(f"tile_{a}.length")
        tiles = tiles.withColumn(f"{a}_core_start", first).withColumn(f"{a}_core_stop", stop)
        tiles = tiles.withColumn(f"{a}_start", F.greatest(first - margin, F.lit(0))).withColumn(f"{a}_stop", F.least(stop + margin, F.lit(sizes[a])))
    return tiles.drop(*[f"tile_{a}" for a in axes], *[f"size_{a}" for a in axes], "tile_name")
