"""Resolution levels: their geometry, and block aggregates from one level to the next."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTEGERS = ("int8", "uint8", "int16", "uint16", "int32", "uint32", "int64")


def level_shapes(base: dict[str, int], factors: dict[str, float], levels: int) -> list[dict[str, int]]:
    """Shapes from the finest level on: each is the one before divided, rounded down, 1 at least."""
    out = [dict(base)]
    for _ in range(levels - 1):
        out.append({a: max(1, math.floor(n / factors.get(a, 1.0))) for a, n in out[-1].items()})
    return out


def level_scales(shapes: list[dict[str, int]], base_scale: dict[str, float]) -> list[dict[str, float]]:
    """Pixel sizes that follow from the rounded shapes."""
    out = [dict(base_scale)]
    for before, now in zip(shapes, shapes[1:], strict=False):
        out.append({a: out[-1][a] * before[a] / now[a] for a in base_scale})
    return out


def levels_table(spark: SparkSession, image: str, base: dict[str, int], scale: dict[str, float], factors: dict[str, float], levels: int) -> DataFrame:
    shapes = level_shapes(base, factors, levels)
    axes = list(base)
    rows = [(image, i, *[s[a] for a in axes], *[float(z[a]) for a in axes]) for i, (s, z) in enumerate(zip(shapes, level_scales(shapes, scale), strict=True))]
    schema = "image string, level int, " + ", ".join(f"size_{a} int" for a in axes) + ", " + ", ".join(f"px_{a} double" for a in axes)
    return spark.createDataFrame(rows, schema)


def levels_rows(spark: SparkSession, image: str, levels: list[tuple[str, dict[str, float]]]) -> DataFrame:
    """(image, level, path, px_<axis>...) of named levels with their scales."""
    axes = list(levels[0][1])
    return spark.createDataFrame([(image, i, p, *[float(s[a]) for a in axes]) for i, (p, s) in enumerate(levels)], "image string, level int, path string, " + ", ".join(f"px_{a} double" for a in axes))


def base_scale(axes: list[str], pixel: float | tuple[float, float], z_spacing: float = 1.0, time_spacing: float = 1.0) -> dict[str, float]:
    """The finest level's scale by axis, from one pixel size or one for y and x each."""
    y, x = pixel if isinstance(pixel, tuple) else (pixel, pixel)
    return {a: {"t": float(time_spacing), "z": float(z_spacing), "y": float(y), "x": float(x)}.get(a, 1.0) for a in axes}


def adapt_scales(scales: list[dict[str, float]], base: dict[str, float]) -> list[dict[str, float]]:
    """The scales of all levels for another pixel size of the finest."""
    return [{a: s * base.get(a, scales[0][a]) / scales[0][a] for a, s in level.items()} for level in scales]


def consolidation_order(shapes: dict[str, dict[str, int]], source: str) -> list[tuple[str, str]]:
    """(from, to) of all levels but the source: always the pair of nearest shapes, of a level that is done and one that is not."""
    done, left, out = [source], [n for n in shapes if n != source], []
    far = lambda a, b: math.dist([math.log(max(shapes[a][k], 1)) for k in shapes[a]], [math.log(max(shapes[b][k], 1)) for k in shapes[a]])
    while left:
        a, b = min(((a, b) for a in done for b in left), key=lambda p: far(*p))
        out.append((a, b))
        done.append(b)
        left.remove(b)
    return out


def cast_back(value: Column, dtype: str | None) -> Column:
    """Into the level's type; means of integers are cut toward zero."""
    return value.cast("long") if dtype in INTEGERS else value


def coarsen(image: DataFrame, factor: dict[str, int], sizes: dict[str, int], how: str = "mean", dtype: str | None = None, value: str = "value", fill: float = 0) -> DataFrame:
    """Blocks of ``factor`` pixels as one pixel: their mean, or their largest value (``max``).

    Blocks over the border are left out. One hash aggregation with partial sums. A pixel without a row
    holds ``fill``: a mean is over all pixels of the block, whether the image stores its background or
    not, and so is the largest value where the block has rows at all. Blocks without rows stay so.
    """
    if how not in ("mean", "max"):
        raise ValueError("how is mean or max")
    kept = image
    for a, f in factor.items():
        kept = kept.where(F.col(a) < sizes[a] // f * f)
    others = [c for c in image.columns if c != value and c not in factor]
    block = [F.floor(F.col(a) / f).cast("int").alias(a) for a, f in factor.items()]
    size = math.prod(factor.values())
    absent = size - F.count(value)
    if how == "mean":
        made = (F.sum(value) + absent * F.lit(fill)) / F.lit(float(size))
    else:
        made = F.greatest(F.max(value), F.when(absent > 0, F.lit(fill)))
    return kept.groupBy(*others, *block).agg(cast_back(made, dtype).alias(value)).select(*image.columns)


def build(image: DataFrame, factor: dict[str, int], sizes: dict[str, int], levels: int, how: str = "mean", dtype: str | None = None) -> list[DataFrame]:
    """All levels, each from the one before."""
    out, shape = [image], dict(sizes)
    for _ in range(levels - 1):
        out.append(coarsen(out[-1], factor, shape, how, dtype))
        shape = {a: n // factor.get(a, 1) for a, n in shape.items()}
    return out


def touched_blocks(regions: list[dict[str, tuple[int, int]]], factor: dict[str, int], unit: dict[str, int], sizes: dict[str, int]) -> list[dict[str, tuple[int, int]]]:
    """Regions of the next level that written regions reach, grown to whole write units and merged."""
    grown = []
    for r in regions:
        box = {}
        for a, (low, high) in r.items():
            f, u = factor.get(a, 1), unit.get(a, 1)
            box[a] = (low // f // u * u, min(sizes[a], -(-(-(-high // f)) // u) * u))
        grown.append(box)
    return merge_regions(grown)


def merge_regions(regions: list[dict[str, tuple[int, int]]]) -> list[dict[str, tuple[int, int]]]:
    """Boxes that touch, even at a corner, become their common box, until none touch. For the tens of boxes of a write."""
    done = [dict(r) for r in regions]
    changed = True
    while changed:
        changed = False
        rest: list[dict[str, tuple[int, int]]] = []
        for box in done:
            for i, other in enumerate(rest):
                if all(box[a][0] <= other[a][1] and other[a][0] <= box[a][1] for a in box):
                    rest[i] = {a: (min(box[a][0], other[a][0]), max(box[a][1], other[a][1])) for a in box}
                    changed = True
                    break
            else:
                rest.append(box)
        done = rest
    return sorted(done, key=lambda b: tuple(b.values()))


def coverage(regions: list[dict[str, tuple[int, int]]], sizes: dict[str, int]) -> float:
    total = math.prod(sizes.values())
    return sum(math.prod(h - low for low, h in r.values()) for r in regions) / total if total else 0.0


def within(regions: list[dict[str, tuple[int, int]]]) -> Column:
    """Predicate of the pixels in any of the boxes."""
    hold = F.lit(False)
    for r in regions:
        one = F.lit(True)
        for a, (low, high) in r.items():
            one &= (F.col(a) >= low) & (F.col(a) < high)
        hold |= one
    return hold


def refresh(fine: DataFrame, coarse: DataFrame, regions: list[dict[str, tuple[int, int]]], factor: dict[str, int], sizes: dict[str, int], unit: dict[str, int], how: str = "mean", dtype: str | None = None, most: float = 0.5) -> DataFrame:
    """The next level after writes to ``regions`` of the finer one: only the blocks that they reach are made again.

    Beyond the share ``most`` of the level all of it is made again. The filters reach the scans, so a
    small write reads a small part.
    """
    next_sizes = {a: n // factor.get(a, 1) for a, n in sizes.items()}
    boxes = touched_blocks(regions, factor, unit, next_sizes)
    if coverage(boxes, next_sizes) > most:
        return coarsen(fine, factor, sizes, how, dtype)
    parents = [{a: (low * factor.get(a, 1), high * factor.get(a, 1)) for a, (low, high) in b.items()} for b in boxes]
    return coarse.where(~within(boxes)).unionByName(coarsen(fine.where(within(parents)), factor, sizes, how, dtype))


def nearest_level(levels: DataFrame, pixel: dict[str, float], by: str = "image", strict: bool = False, eps: float = 1e-6) -> DataFrame:
    """For each image the level whose pixel size is nearest, the first of equals; ``strict`` wants an exact one."""
    total = F.lit(0.0)
    for a, p in pixel.items():
        total = total + (F.col(f"px_{a}") - p) * (F.col(f"px_{a}") - p)
    found = levels.groupBy(by).agg(F.min(F.struct(F.sqrt(total).alias("distance"), "level")).alias("m")).select(by, "m.level", "m.distance")
    if strict:
        wrong = F.raise_error(F.lit("no level has this pixel size")).cast("double")
        found = found.withColumn("distance", F.when(F.col("distance") > eps, wrong).otherwise(F.col("distance")))
    return found
