"""Chunked arrays on a file system as a Spark data source, ``spark.read.format("chunked_array")``.

Each partition reads some of the stored chunks that the selection touches and hands over Arrow batches
that numpy made; chunks that are not stored hold the fill value and are read as such only with
``fill=true``. Array metadata of either layout version is understood (``.zarray`` and ``zarr.json``),
with raw, zlib, gzip, zstd, lz4 and blosc chunks (not bit-shuffled), and with shards; other codecs are an
error. Paths are local or those of Arrow's file systems. Options: ``axes`` (letters in order, ``zyx`` by
default the last ones of ``tczyx``), one selection ``low:high`` per axis, ``fill``. :func:`write_image`
stores an image from the executors.
"""

from __future__ import annotations

import itertools
import json
import math
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A partition holds about so many bytes of decoded chunks.
PARTITION_BYTES = 32 << 20


class Files:
    """Files below a path, local or of another store."""

    def __init__(self, path: str):
        from pyarrow import fs

        parsed = urlparse(path)
        if parsed.scheme in ("", "file"):
            self.system, self.base = fs.LocalFileSystem(), parsed.path
        else:
            self.system, self.base = fs.FileSystem.from_uri(path)

    def read(self, name: str) -> bytes | None:
        try:
            with self.system.open_input_file(f"{self.base}/{name}") as source:
                return source.read()
        except FileNotFoundError:
            return None

    def write(self, name: str, data: bytes) -> None:
        """Whole or not at all on a local file system: a task that is run again replaces its file."""
        target = f"{self.base}/{name}"
        self.system.create_dir(target.rpartition("/")[0], recursive=True)
        local = self.system.type_name == "local"
        part = f"{target}.{uuid.uuid4().hex}" if local else target
        with self.system.open_output_stream(part) as out:
            out.write(data)
        if local:
            os.replace(part, target)


def metadata(path: str) -> dict:
    """shape, chunks, dtype, codecs, fill, order, shards and the file name of a chunk."""
    files = Files(path)
    if (found := files.read("zarr.json")) is not None:
        m = json.loads(found)
        codecs, grid, inner = m["codecs"], m["chunk_grid"]["configuration"]["chunk_shape"], None
        if [c["name"] for c in codecs] == ["sharding_indexed"]:
            held = codecs[0]["configuration"]
            codecs = held["codecs"]
            index = [c["name"] for c in held["index_codecs"]]
            if index not in (["bytes"], ["bytes", "crc32c"]):
                raise ValueError(f"index codecs {index} are not supported")
            inner = {"chunks": held["chunk_shape"], "tail": 4 if "crc32c" in index else 0, "end": held.get("index_location", "end") == "end"}
        endian = next((c.get("configuration", {}).get("endian", "little") for c in codecs if c["name"] == "bytes"), "little")
        key = m.get("chunk_key_encoding", {"name": "default"})
        mark = key.get("configuration", {}).get("separator", "/" if key["name"] == "default" else ".")
        dtype = np.dtype(m["data_type"]).newbyteorder("<" if endian == "little" else ">")
        steps = [c["name"] for c in codecs if c["name"] != "bytes"]
        return _checked({
            "shape": m["shape"], "chunks": grid, "dtype": dtype.str, "codecs": steps, "order": "C", "fill": m.get("fill_value") or 0, "prefix": "c" + mark if key["name"] == "default" else "", "mark": mark, "inner": inner,
        })
    found = files.read(".zarray")
    if found is None:
        raise FileNotFoundError(path)
    m = json.loads(found)
    if m.get("filters"):
        raise ValueError("filters are not supported")
    codec = (m.get("compressor") or {}).get("id")
    return _checked({"shape": m["shape"], "chunks": m["chunks"], "dtype": m["dtype"], "codecs": [codec] if codec else [], "order": m.get("order", "C"), "fill": m.get("fill_value") or 0, "prefix": "", "mark": m.get("dimension_separator", "."), "inner": None})


def _checked(meta: dict) -> dict:
    unknown = [c for c in meta["codecs"] if c not in ("zlib", "gzip", "zstd", "blosc", "crc32c", "lz4")]
    if unknown:
        raise ValueError(f"codecs {unknown} are not supported")
    return meta


def _unzstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _unlz4(data: bytes, size: int) -> bytes:
    return pa.Codec("lz4_raw").decompress(data, size, asbytes=True)


def unblosc(data: bytes) -> bytes:
    """A blosc frame: a header, where each block starts, and blocks of one or more streams."""
    flags, width = data[2], data[3]
    size, block, _ = (int.from_bytes(data[i : i + 4], "little") for i in (4, 8, 12))
    if flags & 2:  # stored as it is
        return data[16 : 16 + size]
    if flags & 4:
        raise ValueError("bit-shuffled blosc chunks are not supported")
    kind = flags >> 5
    if kind not in (1, 3, 4):
        raise ValueError(f"blosc's inner codec {kind} is not supported")
    out = []
    for i in range(-(-size // block) if size else 0):
        at, n = int.from_bytes(data[16 + 4 * i : 20 + 4 * i], "little"), min(block, size - i * block)
        parts = width if not flags & 16 and n == block and width <= 16 and block // width >= 128 else 1
        raw = []
        for _ in range(parts):
            held = int.from_bytes(data[at : at + 4], "little")
            body, want, at = data[at + 4 : at + 4 + held], n // parts, at + 4 + held
            raw.append(body if held == want else _unlz4(body, want) if kind == 1 else zlib.decompress(body) if kind == 3 else _unzstd(body))
        whole = b"".join(raw)
        if flags & 1 and width > 1:
            even = n // width * width
            whole = np.frombuffer(whole[:even], np.uint8).reshape(width, -1).T.tobytes() + whole[even:]
        out.append(whole)
    return b"".join(out)


def decode(data: bytes, meta: dict, shape: list[int]) -> np.ndarray:
    for codec in reversed(meta["codecs"]):
        if codec == "crc32c":
            data = data[:-4]
        elif codec in ("zlib", "gzip"):
            data = zlib.decompress(data, 47)
        elif codec == "zstd":
            data = _unzstd(data)
        elif codec == "lz4":  # its size comes first
            data = _unlz4(data[4:], int.from_bytes(data[:4], "little"))
        elif codec == "blosc":
            data = unblosc(data)
    return np.frombuffer(data, meta["dtype"]).reshape(shape, order=meta["order"])


def decode_file(data: bytes, meta: dict) -> np.ndarray:
    """A stored chunk, or a shard put together from its inner chunks."""
    inner = meta["inner"]
    if inner is None:
        return decode(data, meta, meta["chunks"])
    many = [n // c for n, c in zip(meta["chunks"], inner["chunks"], strict=True)]
    size = 16 * math.prod(many)
    index = data[len(data) - size - inner["tail"] : len(data) - inner["tail"]] if inner["end"] else data[:size]
    places = np.frombuffer(index, "<u8").reshape(-1, 2)
    out = np.full(meta["chunks"], meta["fill"], meta["dtype"])
    for at, (start, n) in zip(itertools.product(*map(range, many)), places.tolist(), strict=True):
        if start != 2**64 - 1:
            out[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, inner["chunks"], strict=True))] = decode(data[start : start + n], meta, inner["chunks"])
    return out


class Chunks(InputPartition):
    def __init__(self, at: list[tuple[int, ...]]):
        super().__init__(at)
        self.at = at


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.meta = metadata(self.path)
        self.axes = axes_of(options, len(self.meta["shape"]))
        self.fill = options.get("fill", "false") == "true"
        self.bounds = []
        for a, n in zip(self.axes, self.meta["shape"], strict=True):
            low, _, high = options.get(a, ":").partition(":")
            self.bounds.append((max(0, int(low or 0)), min(n, int(high or n))))

    def partitions(self) -> list[Chunks]:
        ranges = [range(low // c, -(-high // c)) if high > low else range(0) for (low, high), c in zip(self.bounds, self.meta["chunks"], strict=True)]
        size = math.prod(self.meta["chunks"]) * np.dtype(self.meta["dtype"]).itemsize
        every = itertools.product(*ranges)
        out = []
        while some := list(itertools.islice(every, max(1, PARTITION_BYTES // max(size, 1)))):
            out.append(Chunks(some))
        return out or [Chunks([])]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        meta, files = self.meta, Files(self.path)
        whole = np.dtype(meta["dtype"]).kind in "iu"
        for at in partition.at:
            data = files.read(f"{meta['prefix']}{meta['mark'].join(map(str, at))}")
            if data is None and not self.fill:
                continue
            block = np.full(meta["chunks"], meta["fill"], meta["dtype"]) if data is None else decode_file(data, meta)
            first = [i * c for i, c in zip(at, meta["chunks"], strict=True)]
            cut = tuple(slice(max(low - f, 0), max(min(high - f, c), 0)) for (low, high), f, c in zip(self.bounds, first, meta["chunks"], strict=True))
            part = block[cut]
            places = np.indices(part.shape, np.int32).reshape(part.ndim, -1)
            columns = [pa.array(p + np.int32(f + s.start)) for p, f, s in zip(places, first, cut, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(part.reshape(-1).astype(np.int64 if whole else np.float64))], names=[*self.axes, "value"])


def axes_of(options: dict[str, str], n: int) -> str:
    axes = options.get("axes") or "tczyx"[-n:]
    if len(axes) != n or len(set(axes)) != n:
        raise ValueError(f"axes {axes} do not name {n} dimensions")
    return axes


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunked_array"

    def schema(self) -> str:
        meta = metadata(self.options["path"])
        kind = "long" if np.dtype(meta["dtype"]).kind in "iu" else "double"
        return ", ".join(f"{a} int" for a in axes_of(self.options, len(meta["shape"]))) + f", value {kind}"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options)


def register(spark: SparkSession) -> None:
    from mosaiq.plans.ship import ship

    ship(spark)
    spark.dataSource.register(ArraySource)


def write_image(rows: DataFrame, path: str, shape: dict[str, int], chunk: dict[str, int], dtype: str = "uint16", value: str = "value") -> int:
    """Store pixel rows as an array: each group of rows of a chunk is written by the task that holds it; chunks without
    rows are not stored. Returns the number of chunks. The shuffle moves rows by chunk, of bounded size each."""
    from mosaiq.plans.ship import ship

    ship(rows.sparkSession)
    axes, kind = list(shape), np.dtype(dtype).newbyteorder("<").str
    about = {"zarr_format": 2, "shape": [shape[a] for a in axes], "chunks": [chunk[a] for a in axes], "dtype": kind, "compressor": {"id": "zlib"}, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": "."}
    Files(path).write(".zarray", json.dumps(about).encode())

    def store(group: pa.Table) -> pa.Table:
        first = {a: group[f"__{a}"][0].as_py() for a in axes}
        block = np.zeros([chunk[a] for a in axes], kind)
        block[tuple(group[a].to_numpy() - first[a] * chunk[a] for a in axes)] = group[value].to_numpy()
        Files(path).write(".".join(str(first[a]) for a in axes), zlib.compress(block.tobytes(), 1))
        return pa.table({"n": pa.array([1], pa.int64())})

    numbered = rows.select(*axes, value, *[F.floor(F.col(a) / chunk[a]).cast("int").alias(f"__{a}") for a in axes])
    return numbered.groupBy(*[f"__{a}" for a in axes]).applyInArrow(store, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_array(path: str, array: np.ndarray, chunks: list[int], codec: str | None = "zlib") -> None:
    """A small array on the driver, in the older layout; large images are written by chunk from ``pixels.to_chunks``."""
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/.zarray", "w") as f:
        json.dump({"zarr_format": 2, "shape": list(array.shape), "chunks": chunks, "dtype": array.dtype.str, "compressor": {"id": codec} if codec else None, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": "."}, f)
    for at in itertools.product(*[range(-(-n // c)) for n, c in zip(array.shape, chunks, strict=True)]):
        part = array[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
        block = np.zeros(chunks, array.dtype)
        block[tuple(slice(0, n) for n in part.shape)] = part
        with open(f"{path}/{'.'.join(map(str, at))}", "wb") as f:
            f.write(zlib.compress(block.tobytes()) if codec else block.tobytes())
