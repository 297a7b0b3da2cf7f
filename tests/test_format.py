"""Metadata of stored images and plates, containers on disk, and operators on other resolutions."""

import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from mosaiq import container as C
from mosaiq.operators import checks as K
from mosaiq.operators import pixels as P
from mosaiq.operators import plate as PL
from mosaiq.operators import pyramid as Y
from mosaiq.operators import tiling as TI
from mosaiq.operators import verbs as VB
from mosaiq.sources import ngff as N
from mosaiq.sources import zarr as Z


def image(spark, array, value="value"):
    rows = [(*map(int, at), float(v)) for at, v in np.ndenumerate(array)]
    return spark.createDataFrame(rows, ", ".join(f"{a} int" for a in "zyx"[-array.ndim :]) + f", {value} double")


def back(rows, shape):
    out = np.zeros(shape)
    for *at, v in rows.collect():
        out[tuple(at)] = v
    return out


META = N.ImageMeta(
    (N.Axis("c", "channel"), N.Axis("y", "space", "micrometer"), N.Axis("x", "space", "micrometer")),
    (N.Dataset("0", {"c": 1.0, "y": 0.5, "x": 0.25}), N.Dataset("1", {"c": 1.0, "y": 1.0, "x": 0.5}, {"c": 0.0, "y": 0.25, "x": 0.125})),
    (N.Channel("DAPI", "A01", "0000FF", {"start": 0.0, "end": 9.0, "min": 0.0, "max": 255.0}), N.Channel("GFP")), name="test",
)


@pytest.mark.parametrize("version", N.VERSIONS)
def test_image_metadata(spark, tmp_path, version):
    meta = N.replace(META, version=version, label={"source": {"image": "../.."}})
    path = str(tmp_path / "i.zarr")
    N.write_image(spark, path, meta)
    assert N.read_image(spark, path) == meta and N.version_of(N.attributes(spark, path)) == version
    assert meta.dataset(pixel={"y": 0.9, "x": 0.4}).path == "1" and meta.highest().path == "0" and meta.lowest().path == "1"
    assert meta.scaling_factor() == {"c": 1.0, "y": 2.0, "x": 2.0} and meta.scaling_factor("1") == {"c": 1.0, "y": 1.0, "x": 1.0}
    assert meta.channel("GFP") == 1 and meta.channel(wavelength="A01") == 0
    assert [tuple(r) for r in N.levels(spark, path).select("level", "path", "px_y").collect()] == [(0, "0", 0.5), (1, "1", 1.0)]
    with pytest.raises(KeyError):
        meta.dataset(pixel={"y": 0.9}, strict=True)
    with pytest.raises(KeyError):
        meta.channel("none")
    shown = meta.with_windows([(1, 2), (3, 4)], 0, 255)
    assert shown.channels[1].window == {"start": 3.0, "end": 4.0, "min": 0.0, "max": 255.0}
    like = N.image_like(meta, Y.level_shapes({"c": 2, "y": 9, "x": 8}, {"y": 2.0, "x": 2.0}, 2), {"y": 2.0, "x": 2.0})
    assert like.datasets[1].scale == {"c": 1.0, "y": 4.5, "x": 4.0}


def test_odd_metadata():
    plain = {"multiscales": [{"axes": ["y", "x"], "datasets": [{"path": "a", "coordinateTransformations": [{"type": "scale", "scale": [2, 3]}]}], "coordinateTransformations": [{"type": "scale", "scale": [10, 10]}]}]}
    meta = N.decode_image(plain)
    assert meta.version == "0.4" and meta.datasets[0].scale == {"y": 20.0, "x": 30.0} and meta.axes[0].kind == "space"
    for bad in ({}, {"multiscales": [{"axes": ["y", "x"], "datasets": []}]}, {"multiscales": [{"axes": ["y", "x"], "datasets": [{"path": "a"}]}]}, {"multiscales": [{"axes": ["z", "x"], "datasets": plain["multiscales"][0]["datasets"]}]}):
        with pytest.raises(N.MetadataError):
            N.decode_image(bad)
    assert N.hex_color("#f0a") == "FF00AA" and N.guess_color("my DAPI 1") == "0000FF" and N.guess_color("q") == N.guess_color("q")
    with pytest.raises(N.MetadataError):
        N.hex_color("blue")


@pytest.mark.parametrize("version", N.VERSIONS)
def test_plate_on_disk(spark, tmp_path, version):
    catalog = PL.empty_plate(spark)
    for row, column, path, acquisition in (("B", 3, "0", 0), ("B", 3, "1", 1), ("C", 12, "0", 0)):
        catalog = PL.add_image(catalog, "p", row, column, path, acquisition)
    N.write_plate(spark, str(tmp_path / "p.zarr"), catalog, "p", version)
    found = N.open_plate(spark, str(tmp_path / "p.zarr"))
    assert sorted(map(tuple, found.collect())) == [("p", "B", "03", "0", 0, None), ("p", "B", "03", "1", 1, None), ("p", "C", "12", "0", 0, None)]
    assert sorted(r.path for r in PL.images(found, acquisition=1).collect()) == ["B/03/1"] and PL.acquisitions(found).count() == 2
    N.write_plate(spark, str(tmp_path / "e.zarr"), catalog.limit(0), "e", version)
    assert N.open_plate(spark, str(tmp_path / "e.zarr")).count() == 0


def test_open_stored_image(spark, tmp_path):
    array = np.arange(2 * 8 * 6, dtype="<u2").reshape(2, 8, 6)
    path = str(tmp_path / "i.zarr")
    Z.write_array(f"{path}/0", array, [1, 4, 4])
    Z.write_array(f"{path}/1", array[:, ::2, ::2], [1, 4, 4])
    N.write_image(spark, path, META)
    labels = (array[0] % 3).astype("<u4")
    Z.write_array(f"{path}/labels/cells/0", labels, [4, 4])
    N.write_image(spark, f"{path}/labels/cells", N.ImageMeta((N.Axis("y"), N.Axis("x")), (N.Dataset("0", {"y": 0.5, "x": 0.25}),)))
    (tmp_path / "i.zarr/labels/.zattrs").write_text(json.dumps({"labels": ["cells"]}))
    box = C.open_image(spark, path)
    assert [i.shape for i in box.levels] == [{"c": 2, "y": 8, "x": 6}, {"c": 2, "y": 4, "x": 3}] and box.levels[1].pixel == {"y": 1.0, "x": 0.5}
    assert sorted(r.value for r in box.image().get(c=1, y=slice(2, 8, 3), x=slice(1, 3)).collect()) == sorted(array[1, 2:8:3, 1:3].ravel().tolist())
    view = box.masked_image()
    got = {(r.y, r.x): r.value for r in view.get(1, masked=True, fill=-1).where("c = 0").collect()}
    inside = np.argwhere(labels == 1)
    low, high = inside.min(0), inside.max(0) + 1
    want = np.where(labels == 1, array[0].astype(int), -1)[low[0] : high[0], low[1] : high[1]]
    assert got == {(int(y + low[0]), int(x + low[1])): int(v) for (y, x), v in np.ndenumerate(want)}
    with pytest.raises(KeyError):
        view.get(77)


def _blosc(data, width, inner, block, shuffle=True):
    """A blosc frame as its format description has it, made by hand."""
    out, starts, kind = b"", [], {"lz4": 1, "zlib": 3, "zstd": 4}[inner]
    pack = {"lz4": lambda b: pa.Codec("lz4_raw").compress(b, asbytes=True), "zlib": zlib.compress, "zstd": zstandard.compress}[inner]
    head = 16 + 4 * -(-len(data) // block)
    for i in range(0, len(data), block):
        part = data[i : i + block]
        if shuffle:
            part = np.frombuffer(part, np.uint8).reshape(-1, width).T.tobytes()
        split = width if len(part) == block and block // width >= 128 and inner == "lz4" else 1
        starts.append(head + len(out))
        for k in range(split):
            body = part[k * len(part) // split : (k + 1) * len(part) // split]
            small = pack(body)
            small = small if len(small) < len(body) else body
            out += len(small).to_bytes(4, "little") + small
    flags = int(shuffle) | kind << 5 | (0 if inner == "lz4" else 16)
    sizes = b"".join(n.to_bytes(4, "little") for n in (len(data), block, head + len(out)))
    return bytes([2, 1, flags, width]) + sizes + b"".join(n.to_bytes(4, "little") for n in starts) + out


@pytest.mark.parametrize("inner", ["lz4", "zlib", "zstd"])
def test_blosc_chunks(spark, tmp_path, inner):
    rng = np.random.default_rng(2)
    array = rng.integers(0, 300, (40, 50)).astype("<u2")
    for shuffle in (True, False):
        assert Z.unblosc(_blosc(array.tobytes(), 2, inner, 1024, shuffle)) == array.tobytes()
    Z.write_array(str(tmp_path / "a"), array, [40, 25], None)
    about = json.loads((tmp_path / "a/.zarray").read_text())
    (tmp_path / "a/.zarray").write_text(json.dumps(about | {"compressor": {"id": "blosc", "cname": inner}}))
    for i in range(2):
        (tmp_path / f"a/0.{i}").write_bytes(_blosc(np.ascontiguousarray(array[:, 25 * i : 25 * i + 25]).tobytes(), 2, inner, 512))
    Z.register(spark)
    assert back(spark.read.format("chunked_array").load(str(tmp_path / "a")), (40, 50)).tolist() == array.tolist()


def test_shards(spark, tmp_path):
    array = np.arange(8 * 8, dtype="<u2").reshape(8, 8)
    inner, places, body = [(0, 0), (0, 2), (2, 0), (2, 2)], [], b""
    for y, x in inner:
        if (y, x) == (2, 0):
            places += [2**64 - 1] * 2
            continue
        data = zstandard.compress(np.ascontiguousarray(array[y : y + 2, x : x + 2]).tobytes())
        places += [len(body), len(data)]
        body += data
    path = tmp_path / "s"
    (path / "c/0").mkdir(parents=True)
    (path / "c/0/0").write_bytes(body + np.asarray(places, "<u8").tobytes() + b"crc.")
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd"}]
    shard = {"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 2], "codecs": codecs, "index_codecs": [codecs[0], {"name": "crc32c"}]}}
    about = {"zarr_format": 3, "shape": [8, 8], "data_type": "uint16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [4, 4]}}, "chunk_key_encoding": {"name": "default"}, "codecs": [shard], "fill_value": 9}
    (path / "zarr.json").write_text(json.dumps(about))
    Z.register(spark)
    want = array[:4, :4].copy()
    want[2:4, 0:2] = 9
    assert back(spark.read.format("chunked_array").load(str(path)), (8, 8))[:4, :4].tolist() == want.tolist()
    assert spark.read.format("chunked_array").option("fill", "true").load(str(path)).count() == 64


def test_images_are_stored_by_executors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Z, "PARTITION_BYTES", 64)
    array = np.random.default_rng(3).integers(0, 1000, (9, 11))
    array[:4, :4] = 0
    path = str(tmp_path / "w")
    many = Z.write_image(image(spark, array).where("value <> 0").repartition(5), path, {"y": 9, "x": 11}, {"y": 4, "x": 4})
    assert many == 8 and back(spark.read.format("chunked_array").load(path), (9, 11)).tolist() == array.tolist()
    assert Z.write_image(image(spark, array).limit(0), path + "0", {"y": 9, "x": 11}, {"y": 4, "x": 4}) == 0
    assert spark.read.format("chunked_array").load(path + "0").count() == 0


def test_container_writes(spark, tmp_path):
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 200, (16, 16))
    box = C.create(spark, pixels, {"y": 0.5, "x": 0.5}, "yx").consolidate({"y": 2, "x": 2}, 3)
    path = str(tmp_path / "c")
    first = box.save(path)
    labels = image(spark, (np.add.outer(np.arange(16), np.arange(16)) % 3 == 0).astype(int), "label").withColumn("label", F.col("label").cast("long"))
    again = first.with_label("l", labels).save(path)  # where it was read from
    assert back(again.image().rows, (16, 16)).tolist() == pixels.tolist() and back(again.levels[2].rows, (4, 4)).tolist() == back(box.levels[2].rows, (4, 4)).tolist()
    assert len([p for p in (tmp_path / "c").iterdir() if p.name.startswith("data-")]) == 1
    shown = box.image().percentiles([1, 99]).collect()
    assert len(shown) == 1 and shown[0].c == 0
    patch = spark.createDataFrame([(3, 4, 190), (6, 9, 7)], "y int, x int, value long")
    after = again.write(patch, {"y": 2, "x": 2})
    pixels[3, 4], pixels[6, 9] = 190, 7
    want = C.create(spark, pixels, {"y": 0.5, "x": 0.5}, "yx").consolidate({"y": 2, "x": 2}, 3)
    assert [back(i.rows, tuple(i.shape.values())).tolist() for i in after.levels] == [back(i.rows, tuple(i.shape.values())).tolist() for i in want.levels]
    assert after.write(patch.limit(0), {"y": 2, "x": 2}) is after
    inside = again.masked_image("l").set(1, image(spark, np.full((16, 16), 5)).withColumn("value", F.col("value").cast("long")))
    mask = np.add.outer(np.arange(16), np.arange(16)) % 3 == 0
    old = back(again.image().rows, (16, 16))
    assert back(inside.rows, (16, 16)).tolist() == np.where(mask, 5, old).tolist()
    tabled = box.with_table("t", spark.createDataFrame([(1, 2.0)], "label int, v double"), "feature_table")
    assert tabled.without_table("t").tables == {} and tabled.without_table("x", missing_ok=True).tables.keys() == {"t"}
    with pytest.raises(KeyError):
        box.without_table("t")


@pytest.mark.parametrize(("factor", "size"), [(2.0, 14), (0.5, 3), (1.5, 10), (0.4, 2)])
def test_linear_zoom(spark, factor, size):
    rng = np.random.default_rng(1)
    array = rng.normal(size=(7, 7))
    at = (np.arange(size) + 0.5) / factor - 0.5
    weight = np.maximum(0, 1 - np.abs(at[:, None] - np.arange(7)[None, :]))
    got = back(P.linear_zoom(image(spark, array), {"y": factor, "x": factor}, {"y": size, "x": size}), (size, size))
    assert got == pytest.approx(weight @ array @ weight.T)


def test_dense_means_and_steps(spark):
    array = np.asarray([[4, 0, 8, 8], [0, 0, 0, 4], [1, 1, 0, 0]])
    stored = image(spark, array).where("value <> 0")
    for rows in (image(spark, array), stored):
        got = {(r.y, r.x): r.value for r in Y.coarsen(rows, {"y": 2, "x": 2}, {"y": 3, "x": 4}).collect()}
        assert got == {(0, 0): 1.0, (0, 1): 5.0}
    assert Y.coarsen(stored.withColumn("value", -F.col("value")), {"y": 2, "x": 2}, {"y": 3, "x": 4}, "max").where("x = 0").first().value == 0
    assert {(r.y, r.x) for r in P.select(image(spark, array), {}, y=slice(1, None, 2), x=slice(None, 4, 3)).collect()} == {(1, 0), (1, 3)}
    with pytest.raises(ValueError):
        P.select(stored, {}, y=slice(0, 3, -1))


def test_fit_masks_and_chains(spark):
    array = np.arange(6).reshape(2, 3)
    wide = back(P.fit_to_shape(image(spark, array), {"y": 2, "x": 3}, {"y": 5, "x": 1}), (5, 1))
    assert wide[:, 0].tolist() == [1, 4, 4, 1, 1]
    ids = back(P.fit_to_shape(image(spark, array + 1), {"y": 2, "x": 3}, {"y": 2, "x": 7}, unique=True), (2, 7))
    assert ids.tolist() == [[1, 2, 3, 9, 8, 7, 13], [4, 5, 6, 12, 11, 10, 16]]
    labels = spark.createDataFrame([(0, 0, 1), (0, 1, 0)], "y int, x int, label long")
    masked = P.mask_fill_scaled(image(spark, array + 1), labels, {"y": 0.5, "x": 0.5}, 1)
    assert back(masked, (2, 3)).tolist() == [[1, 2, 0], [4, 5, 0]]
    with pytest.raises(TypeError):
        P.transformed(labels, [lambda d: d.drop("x")])


def test_segmentation(spark):
    array = np.zeros((20, 20))
    array[2:6, 8:13] = array[14:17, 3:5] = 9
    tiles = TI.tile_extents(TI.by_grid(spark.createDataFrame([(20, 20)], "size_y int, size_x int"), {"y": 10, "x": 10}), ["y", "x"], {"y": 20, "x": 20}, 4)
    cut = back(VB.segment(image(spark, array), tiles, lambda a: (a > 0).astype(int), ["y", "x"], 5).select("y", "x", "label"), (20, 20))
    assert set(cut[2:6, 8:10].ravel()) == {1} and set(cut[2:6, 10:13].ravel()) == {6} and (cut > 0).tolist() == (array > 0).tolist()
    whole = back(VB.segment(image(spark, array), tiles, lambda a: (a > 0).astype(int), ["y", "x"], 5, stitched=True).select("y", "x", "label"), (20, 20))
    assert set(whole[2:6, 8:13].ravel()) == {1} and set(whole[14:17, 3:5].ravel()) == {2}
    objects = image(spark, (array > 0).astype(int), "label").withColumn("label", F.col("label").cast("long"))
    own = back(VB.segment_masked(image(spark, array), objects, lambda a: np.where(np.arange(a.shape[1]) < 2, 1, 2) * np.ones(a.shape, int), ["y", "x"], 10).select("y", "x", "label"), (20, 20))
    assert set(np.unique(own)) == {0, 11, 12} and ((own > 0) == (array > 0)).all()
    with pytest.raises(Exception, match="block"):
        VB.segment(image(spark, array), tiles, lambda a: (a > 0) * 7, ["y", "x"], 5).collect()


def test_checks_and_geometry():
    a, b = {"c": 2, "y": 10, "x": 11}, {"y": 5, "x": 6}
    assert K.axes_match(a, b) and not K.axes_match(a, {"x": 1, "y": 1}) and not K.dimensions_match(a, b)
    assert K.dimensions_match({"z": 1, "y": 2, "x": 3}, {"y": 2, "x": 3}) and K.dimensions_match({"y": 1, "x": 3}, {"y": 9, "x": 3}, True)
    assert K.rescalable(a, b, {"y": 1.0, "x": 1.0}, {"y": 2.0, "x": 2.0}) and not K.rescalable(a, {"y": 5, "x": 7}, {"y": 1.0, "x": 1.0}, {"y": 2.0, "x": 2.0})
    for bad in (lambda: K.require_axes_match(a, {"x": 1, "y": 1}), lambda: K.require_dimensions_match(a, b), lambda: K.require_rescalable(a, b, {}, {})):
        with pytest.raises(K.GeometryError):
            bad()
    assert Y.base_scale(["t", "c", "y", "x"], (0.5, 0.25), time_spacing=3) == {"t": 3.0, "c": 1.0, "y": 0.5, "x": 0.25}
    assert Y.adapt_scales([{"y": 1.0}, {"y": 2.5}], {"y": 0.5}) == [{"y": 0.5}, {"y": 1.25}]
    assert Y.consolidation_order({"0": {"y": 64}, "2": {"y": 16}, "1": {"y": 32}}, "0") == [("0", "1"), ("1", "2")]
