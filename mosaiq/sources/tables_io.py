"""Tables in files: a registry of formats, and the table's description beside it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators.tables import KINDS, TableError, TableMeta, storage_order, with_index


@dataclass(frozen=True)
class Format:
    read: Callable[[SparkSession, str, str | None], DataFrame]
    write: Callable[[DataFrame, str], None]


def _read_lists(spark: SparkSession, path: str, schema: str | None) -> DataFrame:
    """A JSON object of equally long lists, one per column."""
    lists = spark.read.option("multiLine", True).json(path)
    names = lists.columns
    rows = lists.select(F.explode(F.arrays_zip(*names)).alias("r")).select("r.*")
    return rows if schema is None else rows.select(*[F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], schema).schema.fields])


def _write_lists(table: DataFrame, path: str) -> None:
    """For small tables: one object holds all rows."""
    numbered = table.select(F.struct("*").alias("r")).agg(F.collect_list("r").alias("rows"))
    lists = numbered.select(*[F.expr(f"transform(rows, r -> r.`{c}`)").alias(c) for c in table.columns])
    lists.write.mode("overwrite").json(path)


FORMATS: dict[str, Format] = {
    "parquet": Format(lambda s, p, k: s.read.schema(k).parquet(p) if k else s.read.parquet(p), lambda t, p: t.write.mode("overwrite").parquet(p)),
    "csv": Format(lambda s, p, k: s.read.schema(k).csv(p, header=True) if k else s.read.csv(p, header=True, inferSchema=True), lambda t, p: t.write.mode("overwrite").csv(p, header=True)),
    "json": Format(_read_lists, _write_lists),
    # the array-like layout's column order, stored as Parquet
    "arrays": Format(lambda s, p, k: s.read.parquet(p), lambda t, p: t.select(*storage_order(t)).write.mode("overwrite").parquet(p)),
}
ALIASES = {"experimental_json_v1": "json", "json_v1": "json", "csv_v1": "csv", "parquet_v1": "parquet", "anndata": "arrays", "anndata_v1": "arrays"}


def add_format(name: str, made: Format, overwrite: bool = False, aliases: tuple[str, ...] = ()) -> None:
    if name in FORMATS and not overwrite:
        raise ValueError(f"there is a format {name}")
    FORMATS[name] = made
    ALIASES.update(dict.fromkeys(aliases, name))


def format_of(name: str) -> Format:
    found = FORMATS.get(ALIASES.get(name, name))
    if found is None:
        raise ValueError(f"unknown format {name}; known: {sorted(FORMATS)}")
    return found


def write_table(table: DataFrame, path: str, meta: TableMeta = KINDS["generic_table"], backend: str = "parquet") -> None:
    """The table at ``path/data`` and its description at ``path/meta``."""
    with_index(table, meta.index_key, meta.index_type)
    format_of(backend).write(table, f"{path}/data")
    described = json.dumps(asdict(meta) | {"backend": backend})
    table.sparkSession.createDataFrame([(described,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> tuple[TableMeta, str]:
    held = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    backend = held.pop("backend")
    return TableMeta(**held), backend


def read_table(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None, strict: bool = True) -> tuple[DataFrame, TableMeta]:
    """The table with its index checked; ``kind`` overrides the stored one, unknown kinds are generic unless strict."""
    meta, backend = read_meta(spark, path)
    if kind is not None:
        meta = KINDS.get(kind, meta)
    elif meta.kind not in KINDS:
        if strict:
            raise TableError(f"unknown kind of table {meta.kind}")
        meta = KINDS["generic_table"]
    table = format_of(backend).read(spark, f"{path}/data", schema)
    return with_index(table, meta.index_key, meta.index_type), meta
