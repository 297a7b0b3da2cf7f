"""Tables of an image and of many images: index rules, concatenation, listing, region tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.regions import span
from mosaiq.plans.scratch import materialise


class TableError(ValueError):
    """A table that does not hold what its type asks for."""


@dataclass(frozen=True)
class TableMeta:
    """What a table says of itself; ``kind`` fixes the defaults."""

    kind: str = "generic_table"
    index_key: str | None = None
    index_type: str | None = None
    region: str | None = None
    extra: dict = field(default_factory=dict)


#: Index key and type by kind of table.
KINDS = {
    "roi_table": TableMeta("roi_table", "FieldIndex", "str"), "masking_roi_table": TableMeta("masking_roi_table", "label", "int"),
    "feature_table": TableMeta("feature_table", "label", "int"), "condition_table": TableMeta("condition_table"), "generic_roi_table": TableMeta("generic_roi_table"),
    "generic_table": TableMeta("generic_table"),
}
ROI_REQUIRED = ("x_micrometer", "y_micrometer", "z_micrometer", "len_x_micrometer", "len_y_micrometer", "len_z_micrometer")


def with_index(table: DataFrame, key: str | None, kind: str | None) -> DataFrame:
    """The index column checked and cast; a column that is missing, or a type other than int and str, is an error."""
    if key is None:
        return table
    if key not in table.columns:
        raise TableError(f"the table has no index column {key}")
    if kind not in ("int", "str"):
        raise TableError(f"an index is int or str, not {kind}")
    return table.withColumn(key, F.col(key).cast("long" if kind == "int" else "string"))


def new_index(extras: list[str], old: str, lazy: bool = True) -> Column:
    """Extras and old index joined by ``_``; a null makes it null (lazy) or stands as text (eager)."""
    parts = [F.col(c).cast("string") for c in [*extras, old]]
    if not lazy:
        parts = [F.coalesce(p, F.lit("None")) for p in parts]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("_"), p)
    return joined


def concat(tables: list[tuple[DataFrame, dict[str, str]]], index: str | None = None, old: str = "label", lazy: bool = True) -> DataFrame:
    """Tables one below the other with their extras as columns; ``lazy`` wants equal columns, otherwise missing ones are null."""
    out = None
    for table, extras in tables:
        own = table
        for name, value in extras.items():
            own = own.withColumn(name, F.lit(value))
        if index is not None:
            own = own.withColumn(index, new_index(list(extras), old, lazy))
        if out is None:
            out = own
        else:
            if lazy and set(out.columns) != set(own.columns):
                raise TableError("lazy concatenation needs equal columns")
            out = out.unionByName(own, allowMissingColumns=not lazy)
    if out is None:
        raise TableError("there are no tables")
    return out


def concat_catalog(rows: DataFrame, extras: list[str], index: str | None = None, old: str = "label", lazy: bool = True) -> DataFrame:
    """The same for tables that one scan reads, where the extras are columns already: no union per image."""
    return rows if index is None else rows.withColumn(index, new_index(extras, old, lazy))


def list_names(catalog: DataFrame, mode: str = "common", kinds: list[str] | None = None, image: str = "image", name: str = "name") -> DataFrame:
    """Names of tables of all images (``common``) or of any (``all``), of some kinds only where given."""
    if mode not in ("common", "all"):
        raise ValueError("mode is common or all")
    kept = catalog if kinds is None else catalog.where(F.col("kind").isin(kinds))
    if mode == "all":
        return kept.select(name).distinct()
    total = catalog.agg(F.countDistinct(image).alias("total"))
    counted = kept.groupBy(name).agg(F.countDistinct(image).alias("n"))
    return counted.join(F.broadcast(total), F.col("n") == F.col("total")).select(name)


def to_regions(table: DataFrame) -> DataFrame:
    """A stored region table as regions: spans x, y, z and t (if stored) in world units; other columns stay."""
    missing = [c for c in ROI_REQUIRED if c not in table.columns]
    if missing:
        raise TableError(f"a region table lacks {missing}")
    out = table
    for a in ("x", "y", "z"):
        out = out.withColumn(a, span(F.col(f"{a}_micrometer"), F.col(f"len_{a}_micrometer")))
    out = out.drop(*ROI_REQUIRED)
    if "t_second" in table.columns and "len_t_second" in table.columns:
        out = out.withColumn("t", span(F.col("t_second"), F.col("len_t_second"))).drop("t_second", "len_t_second")
    return out


def from_regions(regions: DataFrame) -> DataFrame:
    """Regions as they are stored: an open start is 0, an open length 1, a missing z is one plane at 0; x and y must be there."""
    if not {"x", "y"} <= set(regions.columns):
        raise TableError("a stored region has x and y")
    out = regions if "z" in regions.columns else regions.withColumn("z", span(F.lit(0.0), F.lit(1.0)))
    cols = []
    for a in ("x", "y", "z"):
        cols += [F.coalesce(F.col(f"{a}.start"), F.lit(0.0)).alias(f"{a}_micrometer"), F.coalesce(F.col(f"{a}.length"), F.lit(1.0)).alias(f"len_{a}_micrometer")]
    if "t" in regions.columns:
        cols += [F.coalesce(F.col("t.start"), F.lit(0.0)).alias("t_second"), F.coalesce(F.col("t.length"), F.lit(1.0)).alias("len_t_second")]
    return out.select(*[c for c in regions.columns if c not in ("x", "y", "z", "t")], *cols)


def unique_names(regions: DataFrame, name: str = "name", order: str = "row") -> DataFrame:
    """Repeated names get the suffix ``_2``, ``_3``, ... in order, so the result is the same in every run.

    Rows are dealt into ranges of the order and numbered by name within each; a range's numbers go on
    from the rows of the name in earlier ranges. So a frequent name is sorted in as many tasks as there are ranges.
    """
    dealt = materialise(regions.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id()), "names")
    counts = dealt.groupBy(F.col(name).alias("__name"), F.col("__p").alias("__q")).agg(F.count("*").alias("__many"))
    earlier = Window.partitionBy("__name").orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__name", "__q", F.coalesce(F.sum("__many").over(earlier), F.lit(0)).alias("__before"))
    ranked = dealt.withColumn("__n", F.row_number().over(Window.partitionBy(name, "__p").orderBy(order)))
    place = F.col("__n") + F.col("__before")
    named = ranked.join(counts, F.col(name).eqNullSafe(F.col("__name")) & (F.col("__p") == F.col("__q")))
    return named.withColumn(name, F.when(place > 1, F.concat(name, F.lit("_"), place)).otherwise(F.col(name))).select(*regions.columns)


def upsert(table: DataFrame, rows: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Rows added by key; an existing key is replaced, or an error."""
    if not overwrite and not table.join(rows, key, "left_semi").isEmpty():
        raise TableError("a row with this key exists")
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; none is an error."""
    found = table.where(F.col(key) == value)
    if found.isEmpty():
        raise KeyError(f"{key} = {value}")
    return found


def storage_order(table: DataFrame) -> list[str]:
    """Column order of the array-like layout: numbers with fractions and booleans first, then text and whole numbers."""
    inner = {"double", "float", "boolean", "decimal"}
    kinds = {c: k.split("(")[0] for c, k in table.dtypes}
    bad = [c for c, k in kinds.items() if k not in inner | {"string", "bigint", "int", "smallint", "tinyint"}]
    if bad:
        raise TableError(f"columns {bad} cannot be stored")
    return [c for c in table.columns if kinds[c] in inner] + [c for c in table.columns if kinds[c] not in inner]
