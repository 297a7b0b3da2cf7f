"""Metadata of multiscale images, labels, plates and wells in the open JSON layouts 0.4 and 0.5.

Both versions decode into the same records and encode from them; the version is found in the
attributes. Files are read and written through Spark's file systems. A plate has one small file per
well, at most some thousands; those of 0.5 are read by the executors, those of 0.4, whose names Spark's
readers pass over, by the driver.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators.plate import SCHEMA, column_text
from mosaiq.operators.pyramid import levels_rows
from mosaiq.sources.files import exists, read_text, write_text

SPACE, VERSIONS = ("z", "y", "x"), ("0.4", "0.5")
KINDS = {"t": "time", "c": "channel", "z": "space", "y": "space", "x": "space"}


class MetadataError(ValueError):
    """Attributes that are not what the layout asks for."""


@dataclass(frozen=True)
class Axis:
    name: str
    kind: str | None = None
    unit: str | None = None


@dataclass(frozen=True)
class Dataset:
    """One level: its path, and scale and translation by axis."""

    path: str
    scale: dict[str, float]
    translation: dict[str, float] = field(default_factory=dict)

    def pixel(self) -> dict[str, float]:
        return {a: s for a, s in self.scale.items() if a in SPACE}


@dataclass(frozen=True)
class Channel:
    label: str
    wavelength: str | None = None
    color: str = "FFFFFF"
    window: dict[str, float] = field(default_factory=dict)
    active: bool = True


def hex_color(value: str) -> str:
    """Six hex digits in upper case; a leading # is dropped and three digits are doubled."""
    digits = value.removeprefix("#").upper()
    if len(digits) == 3:
        digits = "".join(d + d for d in digits)
    if len(digits) != 6 or any(d not in "0123456789ABCDEF" for d in digits):
        raise MetadataError(f"{value} is not a color")
    return digits


#: Stains whose usual color is known, by a part of the channel's name.
STAINS = {"dapi": "0000FF", "hoechst": "0000FF", "gfp": "00FF00", "fitc": "00FF00", "cy3": "FFFF00", "rfp": "FF0000", "tritc": "FF0000", "cy5": "FF00FF", "brightfield": "808080"}
PALETTE = ("00FFFF", "FF00FF", "FFFF00", "FF0000", "00FF00", "0000FF", "FF8000", "808080")


def guess_color(name: str) -> str:
    """The usual color of a stain, else one that follows from the name."""
    found = next((c for part, c in STAINS.items() if part in name.lower()), None)
    return found or PALETTE[sum(name.encode()) % len(PALETTE)]


@dataclass(frozen=True)
class ImageMeta:
    axes: tuple[Axis, ...]
    datasets: tuple[Dataset, ...]
    channels: tuple[Channel, ...] = ()
    version: str = "0.4"
    name: str | None = None
    label: dict | None = None  # the image-label record, for label images

    def __post_init__(self):
        names = [a.name for a in self.axes]
        if len(set(names)) != len(names) or not {"y", "x"} <= set(names):
            raise MetadataError(f"axes {names}")
        if not self.datasets:
            raise MetadataError("an image has one level at least")
        if self.version not in VERSIONS:
            raise MetadataError(f"version {self.version}")

    def ranked(self) -> list[Dataset]:
        """Levels from the finest pixel on."""
        return sorted(self.datasets, key=lambda d: tuple(d.scale.get(a, 1.0) for a in ("x", "y", "z")))

    def highest(self) -> Dataset:
        return self.ranked()[0]

    def lowest(self) -> Dataset:
        return self.ranked()[-1]

    def dataset(self, path: str | None = None, pixel: dict[str, float] | None = None, strict: bool = False) -> Dataset:
        """A level by path, by the nearest pixel size (the first of equals, exact if ``strict``), or the finest."""
        if path is not None:
            found = next((d for d in self.datasets if d.path == path), None)
            if found is None:
                raise KeyError(path)
            return found
        if pixel is None:
            return self.highest()
        far = [math.dist([d.scale.get(a, 1.0) for a in pixel], list(pixel.values())) for d in self.datasets]
        best = min(range(len(far)), key=far.__getitem__)
        if strict and far[best] > 1e-6:
            raise KeyError(f"no level of pixel size {pixel}")
        return self.datasets[best]

    def scaling_factor(self, path: str | None = None) -> dict[str, float]:
        """How much coarser the next level is by axis; 1 for the last."""
        levels = self.ranked()
        at = levels.index(self.dataset(path))
        after = levels[min(at + 1, len(levels) - 1)]
        return {a: after.scale[a] / levels[at].scale[a] for a in levels[at].scale}

    def channel(self, label: str | None = None, wavelength: str | None = None) -> int:
        """The index of the one channel with a label or a wavelength."""
        found = [i for i, c in enumerate(self.channels) if (label is None or c.label == label) and (wavelength is None or c.wavelength == wavelength)]
        if len(found) != 1:
            raise KeyError(f"{len(found)} channels for {label or wavelength}")
        return found[0]

    def with_windows(self, windows: list[tuple[float, float]], low: float = 0, high: float = 65535) -> ImageMeta:
        """The channels with what is to be shown of each."""
        shown = [replace(c, window={"start": float(a), "end": float(b), "min": float(low), "max": float(high)}) for c, (a, b) in zip(self.channels, windows, strict=True)]
        return replace(self, channels=tuple(shown))


def version_of(attributes: dict) -> str:
    if "ome" in attributes:
        return str(attributes["ome"].get("version", "0.5"))
    for part in (*attributes.get("multiscales", [])[:1], attributes.get("plate"), attributes.get("well")):
        if part and "version" in part:
            return str(part["version"])
    return "0.4"


def _body(attributes: dict) -> dict:
    return attributes["ome"] if "ome" in attributes else attributes


def _transforms(found: list[dict] | None, kind: str, axes: list[str]) -> list[float] | None:
    values = [t[kind] for t in found or [] if t.get("type") == kind]
    if not values:
        return None
    if len(values) > 1 or len(values[0]) != len(axes):
        raise MetadataError(f"{kind} {values} for axes {axes}")
    return [float(v) for v in values[0]]


def decode_image(attributes: dict) -> ImageMeta:
    body = _body(attributes)
    if not body.get("multiscales"):
        raise MetadataError("no multiscales")
    scales = body["multiscales"][0]
    axes = tuple(Axis(a, KINDS.get(a)) if isinstance(a, str) else Axis(a["name"], a.get("type"), a.get("unit")) for a in scales["axes"])
    names = [a.name for a in axes]
    common = _transforms(scales.get("coordinateTransformations"), "scale", names) or [1.0] * len(names)
    datasets = []
    for d in scales["datasets"]:
        own = _transforms(d.get("coordinateTransformations"), "scale", names)
        if own is None:
            raise MetadataError(f"level {d.get('path')} has no scale")
        moved = _transforms(d.get("coordinateTransformations"), "translation", names)
        datasets.append(Dataset(d["path"], {a: x * y for a, x, y in zip(names, own, common, strict=True)}, dict(zip(names, moved, strict=True)) if moved else {}))
    channels = tuple(
        Channel(c.get("label") or f"channel_{i}", c.get("wavelength_id"), hex_color(c.get("color") or "FFFFFF"), c.get("window") or {}, c.get("active", True))
        for i, c in enumerate((body.get("omero") or {}).get("channels", []))
    )
    return ImageMeta(axes, tuple(datasets), channels, version_of(attributes), scales.get("name"), body.get("image-label"))


def encode_image(meta: ImageMeta) -> dict:
    names = [a.name for a in meta.axes]
    datasets = []
    for d in meta.datasets:
        steps = [{"type": "scale", "scale": [d.scale.get(a, 1.0) for a in names]}]
        if d.translation:
            steps.append({"type": "translation", "translation": [d.translation.get(a, 0.0) for a in names]})
        datasets.append({"path": d.path, "coordinateTransformations": steps})
    axes = [{k: v for k, v in (("name", a.name), ("type", a.kind or KINDS.get(a.name)), ("unit", a.unit)) if v is not None} for a in meta.axes]
    scales = {"axes": axes, "datasets": datasets} | ({"name": meta.name} if meta.name else {})
    body: dict = {"multiscales": [scales]}
    if meta.channels:
        body["omero"] = {"channels": [{k: v for k, v in (("label", c.label), ("wavelength_id", c.wavelength), ("color", c.color), ("window", c.window), ("active", c.active)) if v is not None} for c in meta.channels]}
    if meta.label is not None:
        body["image-label"] = meta.label
    return _versioned(body, meta.version, ("multiscales",))


def _versioned(body: dict, version: str, parts: tuple[str, ...]) -> dict:
    """0.5 keeps all under "ome" with the version once; 0.4 has it in each part."""
    if version == "0.5":
        return {"ome": {"version": version} | body}
    for p in parts:
        for one in body[p] if isinstance(body[p], list) else [body[p]]:
            one["version"] = version
    return body


def attributes(spark: SparkSession, path: str) -> dict:
    """The attributes of a group in either layout."""
    if exists(spark, f"{path}/zarr.json"):
        return json.loads(read_text(spark, f"{path}/zarr.json")).get("attributes", {})
    if exists(spark, f"{path}/.zattrs"):
        return json.loads(read_text(spark, f"{path}/.zattrs"))
    raise FileNotFoundError(path)


def write_attributes(spark: SparkSession, path: str, found: dict) -> None:
    """The attributes of a group, in the file of their version."""
    if "ome" in found:
        write_text(spark, f"{path}/zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": found}))
    else:
        write_text(spark, f"{path}/.zgroup", json.dumps({"zarr_format": 2}))
        write_text(spark, f"{path}/.zattrs", json.dumps(found))


def read_image(spark: SparkSession, path: str) -> ImageMeta:
    return decode_image(attributes(spark, path))


def write_image(spark: SparkSession, path: str, meta: ImageMeta) -> None:
    write_attributes(spark, path, encode_image(meta))


def labels(spark: SparkSession, path: str) -> list[str]:
    """Names of an image's labels."""
    try:
        found = attributes(spark, f"{path}/labels")
    except FileNotFoundError:
        return []
    return list(_body(found).get("labels", []))


def levels(spark: SparkSession, path: str) -> DataFrame:
    """(image, level, path, px_<axis>...) of an image, finest first."""
    return levels_rows(spark, path, [(d.path, d.scale) for d in read_image(spark, path).ranked()])


def image_like(meta: ImageMeta, shapes: list[dict[str, int]], pixel: dict[str, float], name: str | None = None) -> ImageMeta:
    """Metadata of an image of other shapes: levels by number, scales by the rounded shapes."""
    from mosaiq.operators.pyramid import level_scales

    base = {a.name: pixel.get(a.name, meta.highest().scale.get(a.name, 1.0)) for a in meta.axes}
    scales = level_scales(shapes, base)
    return replace(meta, datasets=tuple(Dataset(str(i), s) for i, s in enumerate(scales)), name=name)


# -- plates ----------------------------------------------------------------------------------


def encode_plate(catalog: DataFrame, name: str, version: str = "0.4") -> tuple[dict, dict[str, dict]]:
    """(plate attributes, well attributes by path) of a catalog; one record per well on the driver."""
    found = catalog.select("row", column_text(F.col("column")).alias("column"), "path_in_well", "acquisition").distinct().collect()
    rows, columns = sorted({r["row"] for r in found}), sorted({r["column"] for r in found})
    wells: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["row"], r["column"], r["path_in_well"])):
        wells.setdefault(f"{r['row']}/{r['column']}", []).append({"path": r["path_in_well"], "acquisition": r["acquisition"]})
    plate = {
        "name": name, "rows": [{"name": r} for r in rows], "columns": [{"name": c} for c in columns], "acquisitions": [{"id": a} for a in sorted({r["acquisition"] for r in found})],
        "wells": [{"path": w, "rowIndex": rows.index(w.split("/")[0]), "columnIndex": columns.index(w.split("/")[1])} for w in wells],
    }
    return _versioned({"plate": plate}, version, ("plate",)), {w: _versioned({"well": {"images": images}}, version, ("well",)) for w, images in wells.items()}


def write_plate(spark: SparkSession, path: str, catalog: DataFrame, name: str, version: str = "0.4") -> None:
    plate, wells = encode_plate(catalog, name, version)
    for place, found in wells.items():
        write_attributes(spark, f"{path}/{place}", found)
    write_attributes(spark, path, plate)


def open_plate(spark: SparkSession, path: str) -> DataFrame:
    """The catalog of a plate's images (see ``operators.plate``), one row per image of each well."""
    found = attributes(spark, path)
    plate = _body(found)["plate"]
    names = {int(a["id"]): a.get("name") for a in plate.get("acquisitions", [])}
    file = "zarr.json" if "ome" in found else ".zattrs"
    if not plate["wells"]:
        return spark.createDataFrame([], SCHEMA)
    well = "struct<images:array<struct<path:string,acquisition:int>>>"
    shape = f"attributes struct<ome:struct<well:{well}>>" if "ome" in found else f"well {well}"
    files = [f"{path}/{w['path']}/{file}" for w in plate["wells"]]
    if "ome" in found:
        texts = spark.read.text(files, wholetext=True).select("value", F.input_file_name().alias("file"))
    else:
        texts = spark.createDataFrame([(read_text(spark, f), f) for f in files], "value string, file string")
    body = F.col("j.attributes.ome.well.images") if "ome" in found else F.col("j.well.images")
    images = texts.select(F.from_json("value", shape).alias("j"), F.split("file", "/").alias("p")).select("p", F.explode(body).alias("i"))
    known = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v).cast("string"))]) if names else F.lit(None).cast("map<int,string>")
    acquisition = F.coalesce("i.acquisition", F.lit(0))
    return images.select(
        F.lit(plate.get("name", "plate")).alias("plate"), F.element_at("p", -3).alias("row"), column_text(F.element_at("p", -2)).alias("column"), F.col("i.path").alias("path_in_well"),
        acquisition.alias("acquisition"), F.try_element_at(known, acquisition).alias("acquisition_name"),
    )
