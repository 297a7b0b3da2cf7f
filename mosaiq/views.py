"""Images, labels, regions and plates derived from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions.regions import span

EDGE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c, y, x, value) of a sparse image; the scan reads four columns."""
    rows = table(spark, sf_dir, "lineitem")
    at = [(F.col("l_linenumber") % 3).cast("int").alias("c"), (F.col("l_orderkey") % EDGE).cast("int").alias("y"), (F.col("l_partkey") % EDGE).cast("int").alias("x")]
    return rows.groupBy(*at).agg(F.max(F.col("l_quantity").cast("int")).alias("value"))


def label_grid(spark: SparkSession) -> DataFrame:
    """(y, x, label) of every pixel."""
    y, x = F.floor(F.col("id") / EDGE).cast("int"), (F.col("id") % EDGE).cast("int")
    at = spark.range(EDGE * EDGE).select(y.alias("y"), x.alias("x"))
    label = F.floor(F.col("y") / 16) * 16 + F.floor(F.col("x") / 16) + 1
    return at.withColumn("label", F.when((F.col("x") + F.col("y")) % 5 != 0, label).otherwise(0).cast("long"))


def event_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("label"), F.concat("event_type", F.lit("_"), "event_id").alias("name"),
        span(F.col("user_id"), 1 + F.col("event_id") % 17).alias("x"), span(F.col("event_id") % 200, 1 + F.col("event_id") % 13).alias("y"),
    )


def event_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = event_regions(spark, sf_dir)
    return r.select(
        F.col("label").alias("id"), F.col("x.start").alias("x_start"), (F.col("x.start") + F.col("x.length")).alias("x_stop"),
        F.col("y.start").alias("y_start"), (F.col("y.start") + F.col("y.length")).alias("y_stop"),
    )


def plate_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lit("plate").alias("plate"), F.col("r_name").alias("row"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("column"), F.lit("0").alias("path_in_well"),
        (F.col("n_nationkey") % 3).cast("int").alias("acquisition"), F.col("n_nationkey").alias("nation"),
    )


def embedding_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v")).select("y", "x", F.col("v").cast("double").alias("value"))


PIXELS = """pixels AS (SELECT CAST(l_linenumber % 3 AS INTEGER) AS c, CAST(l_orderkey % 256 AS INTEGER) AS y, CAST(l_partkey % 256 AS INTEGER) AS x,
 max(CAST(l_quantity AS INTEGER)) AS value FROM lineitem GROUP BY 1, 2, 3)"""
LABELS = """label_grid AS (SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CASE WHEN (x + y) % 5 <> 0 THEN (y // 16) * 16 + x // 16 + 1 ELSE 0 END AS label
 FROM range(256) a(y), range(256) b(x))"""
REGIONS = """rois AS (SELECT event_id AS label, event_type || '_' || event_id AS name, CAST(user_id AS DOUBLE) AS xs, CAST(1 + event_id % 17 AS DOUBLE) AS xl,
 CAST(event_id % 200 AS DOUBLE) AS ys, CAST(1 + event_id % 13 AS DOUBLE) AS yl FROM events)"""
BOXES = REGIONS + ", boxes AS (SELECT label AS id, xs AS x_start, xs + xl AS x_stop, ys AS y_start, ys + yl AS y_stop FROM rois)"
PLATE = """plate AS (SELECT 'plate' AS plate, r_name AS "row", lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS "column", '0' AS path_in_well,
 CAST(n_nationkey % 3 AS INTEGER) AS acquisition, n_nationkey AS nation FROM nation JOIN region ON n_regionkey = r_regionkey)"""
