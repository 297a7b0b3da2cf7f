"""A container of images, labels and tables with levels, as a handle over DataFrames.

Every verb returns DataFrames or a new container; nothing runs before an action. ``save`` and
``open_container`` keep the parts as Parquet, partitioned by level so that reading a level reads it only.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import regions as R
from mosaiq.operators import labels as L
from mosaiq.operators import pixels as P
from mosaiq.operators import pyramid as Y
from mosaiq.operators import stats as ST
from mosaiq.operators import tables as T
from mosaiq.operators import tiling as TI
from mosaiq.sources.files import delete, exists, read_text, write_text


@dataclass(frozen=True)
class Image:
    """One level: pixel rows, its axes in order, its shape and pixel sizes."""

    rows: DataFrame
    shape: dict[str, int]
    pixel: dict[str, float]
    dtype: str = "uint16"
    value: str = "value"

    @property
    def axes(self) -> list[str]:
        return list(self.shape)

    @property
    def space(self) -> list[str]:
        return [a for a in self.axes if a != "c"]

    def get(self, **selection) -> DataFrame:
        return P.select(self.rows, self.shape, **selection)

    def get_regions(self, regions: DataFrame) -> DataFrame:
        return P.select_regions(self.rows, regions, [a for a in self.space if a in regions.columns], self.pixel, self.shape)

    def set(self, patch: DataFrame, merge="overwrite", mask: DataFrame | None = None) -> Image:
        """The image after a write; the patch's box is looked up first, and only pixels within it are joined."""
        box = P.box_of(patch, self.axes)
        return self if box is None else replace(self, rows=P.write(self.rows, patch, self.axes, merge, self.dtype, mask, self.value, box))

    def whole(self, name: str = "image") -> DataFrame:
        """The region of the whole image."""
        spark = self.rows.sparkSession
        return spark.range(1).select(F.lit(name).alias("name"), *[R.span(F.lit(0.0), F.lit(self.shape[a] * self.pixel.get(a, 1.0))).alias(a) for a in self.space])

    def tiles(self, kind: str = "grid", **kw) -> DataFrame:
        spark = self.rows.sparkSession
        dims = spark.range(1).select(*[F.lit(self.shape[a]).alias(f"size_{a}") for a in self.space])
        return {"grid": TI.by_grid, "blocks": TI.by_blocks, "yx": TI.by_yx, "zyx": TI.by_zyx}[kind](dims, **kw)

    def percentiles(self, q: list[float]) -> DataFrame:
        rows = self.rows if "c" in self.axes else self.rows.withColumn("c", F.lit(0))
        return ST.percentiles(rows, q, "c", self.value)

    def masked(self, labels: Image, label: int | None, fill: float = 0) -> DataFrame:
        return P.mask_fill(self.rows, labels.rows, labels.space, label, fill, self.value)


@dataclass(frozen=True)
class Masked:
    """An image seen object by object."""

    image: Image
    labels: Image

    def region(self, label: int) -> dict[str, tuple[int, int]]:
        """The box of an object; one that isn't there is an error."""
        found = P.box_of(self.labels.rows.where(F.col("label") == label), self.labels.axes)
        if found is None:
            raise KeyError(label)
        return found

    def get(self, label: int, masked: bool = False, fill: float = 0, grow: float = 1.0) -> DataFrame:
        """The pixels of an object's box, ``grow`` times as large; with ``masked`` those outside the object are ``fill``."""
        cut = {}
        for a, (low, high) in self.region(label).items():
            more = (high - low) * (grow - 1) / 2
            cut[a] = slice(max(0, low - more), min(self.image.shape[a], high + more))
        rows = self.image.get(**cut)
        return P.mask_fill(rows, self.labels.rows, self.labels.axes, label, fill, self.image.value) if masked else rows

    def set(self, label: int, patch: DataFrame, merge="overwrite") -> Image:
        """The image after a patch that is written within the object only."""
        return self.image.set(patch, merge, self.labels.rows.where(F.col("label") == label))


@dataclass(frozen=True)
class Container:
    levels: tuple[Image, ...]
    labels: dict[str, Image] = field(default_factory=dict)
    tables: dict[str, tuple[DataFrame, T.TableMeta]] = field(default_factory=dict)

    def image(self, level: int = 0, pixel: dict[str, float] | None = None, strict: bool = False) -> Image:
        """A level by number or by the nearest pixel size (the first of equals)."""
        if pixel is None:
            return self.levels[level]
        far = [sum((i.pixel.get(a, 1.0) - p) ** 2 for a, p in pixel.items()) ** 0.5 for i in self.levels]
        best = min(range(len(far)), key=far.__getitem__)
        if strict and far[best] > 1e-6:
            raise KeyError(f"no level of pixel size {pixel}")
        return self.levels[best]

    def consolidate(self, factor: dict[str, int], levels: int, how: str = "mean") -> Container:
        base = self.levels[0]
        shapes = Y.level_shapes(base.shape, {a: float(f) for a, f in factor.items()}, levels)
        scales = Y.level_scales(shapes, {a: base.pixel.get(a, 1.0) for a in base.axes})
        rows = Y.build(base.rows, factor, base.shape, levels, how, base.dtype)
        return replace(self, levels=tuple(replace(base, rows=r, shape=s, pixel=p) for r, s, p in zip(rows, shapes, scales, strict=True)))

    def derive(self, keep_labels: bool = False, keep_tables: bool = False) -> Container:
        """An empty image of the same geometry."""
        empty = tuple(replace(i, rows=i.rows.limit(0)) for i in self.levels)
        return Container(empty, dict(self.labels) if keep_labels else {}, dict(self.tables) if keep_tables else {})

    def with_label(self, name: str, rows: DataFrame, overwrite: bool = False) -> Container:
        if name in self.labels and not overwrite:
            raise ValueError(f"there is a label {name}")
        base = self.levels[0]
        shape = {a: n for a, n in base.shape.items() if a != "c"}
        return replace(self, labels=self.labels | {name: Image(rows, shape, base.pixel, "uint32", "label")})

    def without_label(self, name: str, missing_ok: bool = False) -> Container:
        if name not in self.labels and not missing_ok:
            raise KeyError(name)
        return replace(self, labels={k: v for k, v in self.labels.items() if k != name})

    def with_table(self, name: str, table: DataFrame, kind: str = "generic_table", overwrite: bool = False) -> Container:
        if name in self.tables and not overwrite:
            raise ValueError(f"there is a table {name}")
        meta = T.KINDS[kind]
        return replace(self, tables=self.tables | {name: (T.with_index(table, meta.index_key, meta.index_type), meta)})

    def list_tables(self, kinds: list[str] | None = None) -> list[str]:
        return [n for n, (_, m) in self.tables.items() if kinds is None or m.kind in kinds]

    def masking_regions(self, label: str) -> DataFrame:
        image = self.labels[label]
        return L.bounding_boxes(image.rows, image.space, image.pixel)

    def without_table(self, name: str, missing_ok: bool = False) -> Container:
        if name not in self.tables and not missing_ok:
            raise KeyError(name)
        return replace(self, tables={k: v for k, v in self.tables.items() if k != name})

    def masked_image(self, label: str | None = None, table: str | None = None, level: int = 0) -> Masked:
        """The image by the objects of a label image, named or that of a masking table (``extra["region"]`` or ``region``), or the only one."""
        if label is None and table is not None:
            meta = self.tables[table][1]
            label = meta.region or meta.extra.get("region")
        if label is None:
            if len(self.labels) != 1:
                raise KeyError(f"{len(self.labels)} labels")
            label = next(iter(self.labels))
        return Masked(self.levels[level], self.labels[label])

    def write(self, patch: DataFrame, factor: dict[str, int], merge="overwrite", how: str = "mean") -> Container:
        """A write to the finest level; of the coarser ones only the blocks that it reaches are made again."""
        base = self.levels[0]
        box = P.box_of(patch, base.axes)
        if box is None:
            return self
        out, region = [base.set(patch, merge)], {a: box[a] for a in base.axes if a in factor}
        for before, level in zip(self.levels, self.levels[1:], strict=False):
            fine = out[-1].rows
            sizes = {a: before.shape[a] for a in factor}
            out.append(replace(level, rows=Y.refresh(fine, level.rows, [region], factor, sizes, {}, how, level.dtype)))
            region = {a: (low // factor[a], min(-(-high // factor[a]), sizes[a] // factor[a])) for a, (low, high) in region.items()}
        return replace(self, levels=tuple(out))

    def measure(self, label: str) -> DataFrame:
        base = self.levels[0]
        return ST.measure(base.rows, self.labels[label].rows, self.labels[label].space, ["c"] if "c" in base.axes else None, base.value)

    def save(self, path: str) -> Container:
        """Write all parts to a folder of their own and then point ``path`` to it, so a container may be saved where it
        was read from. What an earlier save left is deleted last; handles opened before are to be opened again.
        """
        spark = self.levels[0].rows.sparkSession
        old = json.loads(read_text(spark, f"{path}/about.json"))["data"] if exists(spark, f"{path}/about.json") else None
        top, path = path, f"{path}/data-{uuid.uuid4().hex[:12]}"
        about = {"levels": [], "labels": {}, "tables": {}, "data": path.rpartition("/")[2]}
        for i, image in enumerate(self.levels):
            image.rows.write.mode("overwrite").parquet(f"{path}/levels/level={i}")
            about["levels"].append([image.shape, image.pixel, image.dtype, image.value])
        for name, image in self.labels.items():
            image.rows.write.mode("overwrite").parquet(f"{path}/labels/{name}")
            about["labels"][name] = [image.shape, image.pixel, image.dtype, image.value]
        for name, (table, meta) in self.tables.items():
            T.from_regions(table).write.mode("overwrite").parquet(f"{path}/tables/{name}") if meta.kind.endswith("roi_table") and "x" in table.columns else table.write.mode("overwrite").parquet(f"{path}/tables/{name}")
            about["tables"][name] = meta.kind
        write_text(spark, f"{top}/about.json", json.dumps(about))
        if old:
            delete(spark, f"{top}/{old}")
        return open_container(spark, top)


def open_container(spark: SparkSession, path: str) -> Container:
    about = json.loads(read_text(spark, f"{path}/about.json"))
    path = f"{path}/{about['data']}"
    read = lambda place, held: Image(spark.read.parquet(f"{path}/{place}"), *held)
    tables = {}
    for name, kind in about["tables"].items():
        stored = spark.read.parquet(f"{path}/tables/{name}")
        regions = kind.endswith("roi_table") and "x_micrometer" in stored.columns
        tables[name] = (T.to_regions(stored) if regions else stored, T.KINDS[kind])
    levels = tuple(read(f"levels/level={i}", held) for i, held in enumerate(about["levels"]))
    return Container(levels, {n: read(f"labels/{n}", held) for n, held in about["labels"].items()}, tables)


def create(spark: SparkSession, array, pixel: dict[str, float], axes: str, dtype: str = "uint16") -> Container:
    """A container of one level from a small numpy array."""
    import numpy as np

    rows = [(*map(int, at), int(v)) for at, v in np.ndenumerate(array)]
    schema = ", ".join(f"{a} int" for a in axes) + ", value long"
    return Container((Image(spark.createDataFrame(rows, schema), dict(zip(axes, map(int, array.shape), strict=True)), pixel, dtype),))


def open_image(spark: SparkSession, path: str) -> Container:
    """A stored multiscale image with its labels, levels finest first, read chunk by chunk when asked for."""
    from mosaiq.sources import ngff, zarr

    zarr.register(spark)

    def levels(place: str, value: str) -> tuple[Image, ...]:
        meta = ngff.read_image(spark, place)
        axes, out = "".join(a.name for a in meta.axes), []
        for d in meta.ranked():
            about = zarr.metadata(f"{place}/{d.path}")
            rows = spark.read.format("chunked_array").option("path", f"{place}/{d.path}").option("axes", axes).load().withColumnRenamed("value", value)
            out.append(Image(rows, dict(zip(axes, map(int, about["shape"]), strict=True)), d.pixel(), zarr.np.dtype(about["dtype"]).name, value))
        return tuple(out)

    return Container(levels(path, "value"), {n: levels(f"{path}/labels/{n}", "label")[0] for n in ngff.labels(spark, path)})


def synthetic(spark: SparkSession, shape: dict[str, int], pixel: dict[str, float], dtype: str = "uint16") -> Container:
    """A container of one level with a pattern, made where it is stored."""
    size = 1
    for n in shape.values():
        size *= n
    at, rest = [], F.col("id")
    for a in reversed(shape):
        at.append((rest % shape[a]).cast("int").alias(a))
        rest = F.floor(rest / shape[a])
    rows = spark.range(size).select(*reversed(at), F.pmod(F.xxhash64("id"), F.lit(256)).cast("long").alias("value"))
    return Container((Image(rows, dict(shape), pixel, dtype),))
