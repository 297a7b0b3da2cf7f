"""Images as rows (coordinates, value), and as chunks of bytes for array kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.regions import to_pixel, to_slice

#: Number of values of the unsigned types; sums wrap around.
WIDTHS = {"uint8": 2**8, "uint16": 2**16, "uint32": 2**32}


def selection(axis: str, what, size: int | None = None) -> Column:
    """Predicate of an axis: a slice, a number or a list of numbers; outside the axis is an error for the last two."""
    c = F.col(axis)
    if what is None:
        return F.lit(True)
    if isinstance(what, slice):
        low, high, step = what.start, what.stop, 1 if what.step is None else what.step
        if not isinstance(step, int) or step < 1:
            raise ValueError(f"{axis}: a step is a whole number from 1 on")
        hold = F.lit(True)
        if step > 1:
            hold &= (c - int(max(0, (low or 0) // 1))) % step == 0
        if low is not None:
            hold &= c >= int(max(0, low // 1))
        if high is not None:
            hold &= c < int(-(-high // 1))
        return hold
    several = [what] if isinstance(what, int) else sorted(what)
    if size is not None and any(v < 0 or v >= size for v in several):
        raise IndexError(f"{axis}: {several} is not within 0..{size - 1}")
    if several == list(range(several[0], several[-1] + 1)):
        return c.between(several[0], several[-1])
    return c.isin(several)


def select(image: DataFrame, sizes: dict[str, int] | None = None, **by_axis) -> DataFrame:
    """Rows of a selection per axis. An axis picked by a number is dropped; one the image lacks may be picked by 0, 0:1 or None only."""
    sizes = sizes or {}
    out = image
    for axis, what in by_axis.items():
        if axis not in image.columns:
            if not (what in (None, 0) or isinstance(what, slice) and (what.start or 0, what.stop) == (0, 1)):
                raise ValueError(f"the image has no axis {axis}")
            continue
        out = out.where(selection(axis, what, sizes.get(axis)))
        if isinstance(what, int):
            out = out.drop(axis)
    return out


def reorder(image: DataFrame, axes: list[str], value: str = "value") -> DataFrame:
    """The image with the axes asked for: those it lacks are added as 0, those left out must hold 0 only."""
    have = [c for c in image.columns if c != value]
    for a in (a for a in have if a not in axes):
        image = image.withColumn(a, F.when(F.col(a) == 0, 0).otherwise(F.raise_error(F.lit(f"axis {a} has more than one pixel")).cast("int")))
    return image.select(*[F.col(a) if a in have else F.lit(0).alias(a) for a in axes], value)


def select_regions(image: DataFrame, regions: DataFrame, axes: list[str], pixel: dict[str, float], sizes: dict[str, int], cell: int = 64) -> DataFrame:
    """Pixels of each region (world spans per axis) with the region's columns; joined by coarse cells, not by a cross join."""
    cut = regions
    for a in axes:
        cut = cut.withColumn(f"__s_{a}", to_slice(to_pixel(F.col(a), F.lit(pixel.get(a, 1.0))), F.lit(sizes[a])))
    keys = []
    for a in axes[-2:]:
        cut = cut.where(F.col(f"__s_{a}.first") < F.col(f"__s_{a}.stop"))
        cut = cut.withColumn(f"__c_{a}", F.explode(F.sequence(F.floor(F.col(f"__s_{a}.first") / cell), F.floor((F.col(f"__s_{a}.stop") - 1) / cell))))
        keys.append(f"__c_{a}")
    own = [c for c in regions.columns if c not in axes]
    cut = cut.select(*own, *keys, *[f"__s_{a}" for a in axes])
    marked = image.select("*", *[F.floor(F.col(a) / cell).alias(f"__c_{a}") for a in axes[-2:]])
    hold = F.lit(True)
    for a in axes:
        hold &= (F.col(a) >= F.col(f"__s_{a}.first")) & (F.col(a) < F.col(f"__s_{a}.stop"))
    return marked.join(cut, keys).where(hold).select(*own, *image.columns)


def channels(image: DataFrame, table: DataFrame, **by) -> DataFrame:
    """Pixels of the channels whose label, wavelength or index (``c``) is given; none or several for a single value is an error."""
    (column, wanted), = by.items()
    several = wanted if isinstance(wanted, (list, tuple)) else [wanted]
    found = table.where(F.col(column).isin(*several)).select("c", column).collect()  # a channel list has tens of rows
    if len(found) != len(set(several)):
        raise ValueError(f"{column}: {len(found)} channels for {several}")
    return image.where(F.col("c").isin([r["c"] for r in found]))


def mask_fill(image: DataFrame, labels: DataFrame, axes: list[str], label: int | None, fill: float = 0, value: str = "value") -> DataFrame:
    """Values outside the object ``label`` (any object if None) replaced. The labels have no channel axis."""
    inside = F.col("__l") == label if label is not None else F.col("__l") != 0
    named = labels.select(*axes, F.col("label").alias("__l"))
    return image.join(named, axes, "left").withColumn(value, F.when(F.coalesce(inside, F.lit(False)), F.col(value)).otherwise(F.lit(fill))).drop("__l").select(*image.columns)


def merged(rule, old: Column, new: Column, dtype: str | None = None) -> Column:
    """What a write leaves where a patch meets existing values; a function of the two columns may be given instead of a name."""
    if callable(rule):
        return rule(old, new)
    if rule == "overwrite":
        return new
    if rule == "max":
        return F.greatest(old, new)
    if rule == "min":
        return F.least(old, new)
    if rule == "sum":
        total = old + new
        return F.pmod(total.cast("long"), F.lit(WIDTHS[dtype])) if dtype in WIDTHS else total
    if rule == "keep_nonzero":
        return F.when(new != 0, new).otherwise(old)
    raise ValueError(f"unknown rule {rule}")


def box_of(patch: DataFrame, axes: list[str]) -> dict[str, tuple[int, int]] | None:
    """The box of a patch, None for an empty one; one row of smallest and largest coordinates is read."""
    found = patch.agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("low", F.min), ("high", F.max))]).first()
    return None if found[f"low_{axes[0]}"] is None else {a: (found[f"low_{a}"], found[f"high_{a}"] + 1) for a in axes}


def write(image: DataFrame, patch: DataFrame, axes: list[str], rule: str = "overwrite", dtype: str | None = None, mask: DataFrame | None = None, value: str = "value", box: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """The image after a patch: merged where both have pixels (within the mask), added where only the patch has.

    With ``box``, which must hold the patch, only the pixels within it are joined; the others are passed on as they are.
    """
    if box is not None:
        inside = F.lit(True)
        for a, (low, high) in box.items():
            inside &= (F.col(a) >= low) & (F.col(a) < high)
        done = write(image.where(inside), patch, axes, rule, dtype, mask, value)
        return done.unionByName(image.where(~inside).select(done.columns))
    new = patch.select(*axes, F.col(value).alias("__n"))
    if mask is not None:
        new = new.join(mask.where(F.col("label") != 0).select(*axes), axes, "left_semi")
    both = image.select(*axes, F.col(value).alias("__o")).join(new, axes, "full")
    done = F.when(F.col("__n").isNull(), F.col("__o")).when(F.col("__o").isNull(), F.col("__n")).otherwise(merged(rule, F.col("__o"), F.col("__n"), dtype))
    return both.select(*axes, done.alias(value))


def nearest_zoom(image: DataFrame, factor: dict[str, float], sizes: dict[str, int], value: str = "value") -> DataFrame:
    """Each target pixel takes the source pixel under its centre. ``factor`` is target over source, ``sizes`` the target's."""
    out = image
    for a, f in factor.items():
        out = out.withColumn("__to", F.explode(_targets(F.col(a), f, sizes[a]))).withColumn(a, F.col("__to")).drop("__to")
    return out.select(*image.columns)


def _targets(source: Column, factor: float, size: int) -> Column:
    """The target pixels of an axis whose centre lies in a source pixel."""
    low = F.greatest(F.floor(source * factor).cast("int") - 1, F.lit(0))
    high = F.greatest(F.least(F.ceil((source + 1) * factor).cast("int"), F.lit(size - 1)), low)
    return F.filter(F.sequence(low, high), lambda i: (F.floor((i + 0.5) / factor).cast("int") == source) & (i < size))


def linear_zoom(image: DataFrame, factor: dict[str, float], sizes: dict[str, int], value: str = "value") -> DataFrame:
    """Linear resampling along each axis: a target pixel's centre lies between two source centres, which
    share it by distance; beyond the border, and where the image has no rows, values are 0.

    Each source pixel hands weighted values to the targets around it, which are summed up per target:
    one aggregation with partial sums, whatever the number of axes.
    """
    out, weight = image, F.lit(1.0)
    for a, f in factor.items():
        first = F.greatest(F.floor((F.col(a) - 0.5) * f - 0.5).cast("int"), F.lit(0))
        last = F.least(F.ceil((F.col(a) + 1.5) * f - 0.5).cast("int"), F.lit(sizes[a] - 1))
        out = out.withColumn(f"__t_{a}", F.explode(F.sequence(first, F.greatest(last, first))))
        # a target's centre among the source's
        near = 1 - F.abs((F.col(f"__t_{a}") + 0.5) / F.lit(float(f)) - 0.5 - F.col(a))
        out, weight = out.where((near > 0) & (F.col(f"__t_{a}") < sizes[a])), weight * near
    others = [c for c in image.columns if c != value and c not in factor]
    return out.groupBy(*others, *[F.col(f"__t_{a}").alias(a) for a in factor]).agg(F.sum(F.col(value) * weight).alias(value)).select(*image.columns)


def fit_to_shape(image: DataFrame, have: dict[str, int], want: dict[str, int], value: str = "value", unique: bool = False) -> DataFrame:
    """The centre of the image where it is larger than asked for; where it is smaller, the image again and
    again, every second time mirrored. With ``unique`` each repetition gets ids of its own."""
    out = image
    top = image.agg(F.max(value)).first()[0] if unique else None
    for a, n in want.items():
        m = have[a]
        if n <= m:
            low = (m - n) // 2
            out = out.where(F.col(a).between(low, low + n - 1)).withColumn(a, F.col(a) - low)
            continue
        out = out.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(-(-n // m) - 1))))
        out = out.withColumn(a, F.col("__k") * m + F.when(F.col("__k") % 2 == 0, F.col(a)).otherwise(m - 1 - F.col(a))).where(F.col(a) < n)
        if unique and top:
            out = out.withColumn(value, F.when(F.col(value) > 0, F.col(value) + F.col("__k") * top).otherwise(F.col(value)))
            top = top * -(-n // m)
        out = out.drop("__k")
    return out.select(*image.columns)


def mask_fill_scaled(image: DataFrame, labels: DataFrame, factor: dict[str, float], label: int | None, fill: float = 0, value: str = "value") -> DataFrame:
    """As :func:`mask_fill` with labels of another resolution: a pixel takes the label under its centre (``factor`` is labels over image)."""
    keys = {a: F.floor((F.col(a) + 0.5) * f).cast("int") for a, f in factor.items()}
    named = labels.select(*[F.col(a).alias(f"__k_{a}") for a in factor], F.col("label").alias("__l"))
    inside = F.col("__l") == label if label is not None else F.col("__l") != 0
    marked = image.select("*", *[k.alias(f"__k_{a}") for a, k in keys.items()]).join(named, [f"__k_{a}" for a in factor], "left")
    return marked.withColumn(value, F.when(F.coalesce(inside, F.lit(False)), F.col(value)).otherwise(F.lit(fill))).select(*image.columns)


def transformed(image: DataFrame, steps: list) -> DataFrame:
    """The image after each step, a function from DataFrame to DataFrame that keeps its columns."""
    for step in steps:
        out = step(image)
        if not isinstance(out, DataFrame) or set(out.columns) != set(image.columns):
            raise TypeError("a step returns the columns that it was given")
        image = out.select(*image.columns)
    return image


def match_shape(image: DataFrame, have: dict[str, int], want: dict[str, int], tolerance: int = 1, fill: float = 0, value: str = "value") -> DataFrame:
    """Pixels trimmed or padded to another shape that differs by ``tolerance`` at most; a single pixel is spread over its axis."""
    out = image
    for a, n in want.items():
        m = have.get(a, 1)
        if m == 1 and n > 1:
            out = out.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        elif abs(m - n) > tolerance:
            raise ValueError(f"axis {a} has {m} pixels, not {n}")
        elif m > n:
            out = out.where(F.col(a) < n)
        elif m < n:
            others = [c for c in image.columns if c not in (a, value)]
            edge = out.select(*others).distinct().withColumn(a, F.explode(F.sequence(F.lit(m), F.lit(n - 1)))).withColumn(value, F.lit(fill))
            out = out.unionByName(edge.select(*image.columns))
    return out.select(*[c for c in out.columns if c != value], value)


def to_chunks(image: DataFrame, axes: list[str], chunk: dict[str, int], keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """One row per chunk: chunk numbers and the list of (offset in the chunk, value)."""
    keys = keys or []
    place = F.lit(0).cast("long")
    for a in axes:
        place = place * chunk[a] + F.col(a) % chunk[a]
    numbered = image.select(*keys, *[F.floor(F.col(a) / chunk[a]).cast("int").alias(f"chunk_{a}") for a in axes], F.struct(place.alias("at"), F.col(value).alias("v")).alias("p"))
    return numbered.groupBy(*keys, *[f"chunk_{a}" for a in axes]).agg(F.array_sort(F.collect_list("p")).alias("data"))


def from_chunks(chunks: DataFrame, axes: list[str], chunk: dict[str, int], keys: list[str] | None = None, value: str = "value") -> DataFrame:
    keys = keys or []
    flat = chunks.select(*keys, *[f"chunk_{a}" for a in axes], F.explode("data").alias("p"))
    out, rest = [], F.col("p.at")
    for a in reversed(axes):
        out.append((F.col(f"chunk_{a}") * chunk[a] + rest % chunk[a]).cast("int").alias(a))
        rest = F.floor(rest / chunk[a])
    return flat.select(*keys, *reversed(out), F.col("p.v").alias(value))
