"""Region algebra as column expressions.

A region is a row with one struct column per axis, ``struct<start:double, length:double>``. A null
struct means the region has no such axis; a null field means the region is open on that side. Bounds
follow the half-open rule [start, start + length). An end of exactly 0 counts as open, and so does an
end with a null start or length; a null start counts as 0 when two spans are combined.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("t", "z", "y", "x")
INF = float("inf")
#: Values this near to a whole pixel are that pixel.
SNAP = 1e-2


def span(start: Column, length: Column) -> Column:
    return F.struct(start.cast("double").alias("start"), length.cast("double").alias("length"))


def no_span() -> Column:
    return F.lit(None).cast("struct<start:double,length:double>")


def end_of(s: Column) -> Column:
    """Null where either bound is open."""
    return s["start"] + s["length"]


def low_of(s: Column) -> Column:
    return F.coalesce(s["start"], F.lit(0.0))


def high_of(s: Column) -> Column:
    return F.coalesce(F.nullif(end_of(s), F.lit(0.0)), F.lit(INF))


def _bounded(low: Column, high: Column) -> Column:
    return span(low, F.when(high == INF, None).otherwise(F.greatest(high - low, F.lit(0.0))))


def meets(a: Column, b: Column) -> Column:
    """Whether two spans of an axis overlap; touching is not overlapping, and a missing axis never parts."""
    return a.isNull() | b.isNull() | (F.greatest(low_of(a), low_of(b)) < F.least(high_of(a), high_of(b)))


def meet(a: Column, b: Column) -> Column:
    """The common part of spans that meet; an axis of one region only is copied as it is."""
    both = _bounded(F.greatest(low_of(a), low_of(b)), F.least(high_of(a), high_of(b)))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def join(a: Column, b: Column) -> Column:
    """The smallest span around both."""
    both = _bounded(F.least(low_of(a), low_of(b)), F.greatest(high_of(a), high_of(b)))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def to_pixel_value(value: Column, pixel: Column) -> Column:
    exact = value / pixel
    return F.when(F.abs(F.bround(exact) - exact) < SNAP, F.bround(exact)).otherwise(exact)


def to_pixel(s: Column, pixel: Column) -> Column:
    return F.when(s.isNotNull(), span(to_pixel_value(s["start"], pixel), to_pixel_value(s["length"], pixel)))


def to_world(s: Column, pixel: Column) -> Column:
    return F.when(s.isNotNull(), span(s["start"] * pixel, s["length"] * pixel))


def zoom(s: Column, factor: float) -> Column:
    """Scaled about the centre; a start below 0 becomes 0 and the length stays. Open lengths stay open."""
    if factor <= 0:
        raise ValueError("a zoom factor is above 0")
    more = s["length"] * (factor - 1.0)
    scaled = span(F.greatest(low_of(s) - more / 2, F.lit(0.0)), s["length"] + more)
    return F.when(s["length"].isNull(), s).otherwise(scaled)


def to_slice(s: Column, size: Column) -> Column:
    """Whole pixels [first, stop) that a pixel span reads from an axis of ``size``."""
    size = size.cast("double")
    inside = lambda v: F.least(F.greatest(v, F.lit(0.0)), size).cast("int")
    first = inside(F.floor(F.coalesce(s["start"], F.lit(0.0))).cast("double"))
    stop = F.when(end_of(s).isNull(), size.cast("int")).otherwise(inside(F.ceil(end_of(s)).cast("double")))
    return F.struct(first.alias("first"), stop.alias("stop"))


def halo(first: Column, stop: Column, margin: int, size: Column) -> Column:
    """A slice grown by a margin within the axis, and how much it grew on either side."""
    low, high = F.greatest(first - margin, F.lit(0)), F.least(stop + margin, size)
    return F.struct(low.alias("first"), high.alias("stop"), (first - low).alias("before"), (high - stop).alias("after"))


def anchor(region: Column, local: Column, pixel: Column) -> Column:
    """A box found at pixel offsets in a world region's patch, in world units; axes it lacks come from the region."""
    origin = F.coalesce(F.floor(F.greatest(to_pixel_value(region["start"], pixel), F.lit(0.0))).cast("double"), F.lit(0.0))
    placed = to_world(span(origin + local["start"], local["length"]), pixel)
    return F.when(local.isNull(), to_world(to_pixel(region, pixel), pixel)).otherwise(placed)


def joined_name(a: Column, b: Column) -> Column:
    return F.when(a.eqNullSafe(b), a).when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, F.lit(":"), b))


def joined_label(a: Column, b: Column) -> Column:
    """Unequal labels are an error; 0 is a label."""
    clash = a.isNotNull() & b.isNotNull() & (a != b)
    return F.when(clash, F.raise_error(F.lit("regions with unequal labels cannot be combined")).cast("long")).otherwise(F.coalesce(a, b))


def shown_name(name: Column, label: Column) -> Column:
    return F.coalesce(name, label.cast("string"), F.lit("region"))


def chunk_rect(first: Column, stop: Column, chunk: Column) -> Column:
    """Inclusive range of the chunks that a slice touches; null for an empty slice."""
    return F.when(stop > first, F.struct(F.floor(first / chunk).cast("int").alias("first"), F.floor((stop - 1) / chunk).cast("int").alias("last")))


def rects_meet(a: Column, b: Column) -> Column:
    return F.coalesce((a["first"] <= b["last"]) & (b["first"] <= a["last"]), F.lit(False))


def volume(*parts: Column) -> Column:
    """Area of a pixel from its sizes along y and x, volume with z."""
    total = parts[0]
    for p in parts[1:]:
        total = total * p
    return total


def norm(*parts: Column) -> Column:
    """Euclidean length of a pixel size."""
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)
