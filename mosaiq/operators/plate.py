"""Plates as a catalog of images: plate, row, column, path_in_well, acquisition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "plate string, row string, column string, path_in_well string, acquisition int, acquisition_name string"


def column_text(column) -> Column:
    """1, "1" and "01" are the same column."""
    c = column if isinstance(column, Column) else F.lit(str(column))
    text = c.cast("string")
    return F.when(text.rlike(r"^\d+$"), F.lpad(text.cast("long").cast("string"), 2, "0")).otherwise(text)


def empty_plate(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def add_image(catalog: DataFrame, plate: str, row: str, column, path: str, acquisition: int = 0, name: str | None = None) -> DataFrame:
    """The catalog with one image more; one that is there already is an error."""
    if not path.isalnum():
        raise ValueError("a path in a well has letters and digits only")
    new = catalog.sparkSession.createDataFrame([(plate, row, str(column), path, acquisition, name)], SCHEMA).withColumn("column", column_text(F.col("column")))
    if not catalog.join(new, ["plate", "row", "column", "path_in_well"], "left_semi").isEmpty():
        raise ValueError("the image is in the plate already")
    return catalog.unionByName(new)


def remove_image(catalog: DataFrame, plate: str, row: str, column, path: str) -> DataFrame:
    gone = (F.col("plate") == plate) & (F.col("row") == row) & (F.col("column") == column_text(column)) & (F.col("path_in_well") == path)
    if catalog.where(gone).isEmpty():
        raise KeyError(f"{row}/{column}/{path}")
    return catalog.where(~gone)


def images(catalog: DataFrame, acquisition: int | None = None, row: str | None = None, column=None) -> DataFrame:
    """Images of an acquisition or a well, with their paths; the filters reach the scan."""
    out = catalog
    if acquisition is not None:
        out = out.where(F.col("acquisition") == acquisition)
    if row is not None:
        out = out.where(F.col("row") == row)
    if column is not None:
        out = out.where(F.col("column") == column_text(column))
    return out.withColumn("path", F.concat_ws("/", "row", "column", "path_in_well"))


def wells(catalog: DataFrame) -> DataFrame:
    """Wells with the places of their rows (as text) and columns (as padded text) in order."""
    found = catalog.select("plate", "row", "column").distinct()
    place = lambda c: F.array_position(F.array_sort(F.collect_set(c).over(_plate())), F.col(c)) - 1
    return found.select("plate", "row", "column", place("row").alias("row_index"), place("column").alias("column_index"), F.concat_ws("/", "row", "column").alias("path"))


def _plate():
    from pyspark.sql import Window

    return Window.partitionBy("plate")


def acquisitions(catalog: DataFrame) -> DataFrame:
    return catalog.select("plate", "acquisition").distinct()


def derive(catalog: DataFrame, name: str, keep_acquisitions: bool = False) -> dict[str, DataFrame]:
    """A new plate's rows, columns and, if kept, acquisitions; it has no wells."""
    out = {"rows": catalog.select(F.lit(name).alias("plate"), "row").distinct(), "columns": catalog.select(F.lit(name).alias("plate"), "column").distinct()}
    if keep_acquisitions:
        out["acquisitions"] = catalog.select(F.lit(name).alias("plate"), "acquisition", "acquisition_name").distinct()
    return out
