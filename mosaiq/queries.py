"""The engine's queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq import views as V
from mosaiq.functions import regions as R
from mosaiq.operators import labels as L
from mosaiq.operators import pixels as P
from mosaiq.operators import plate as PL
from mosaiq.operators import pyramid as Y
from mosaiq.operators import spatial as S
from mosaiq.operators import stats as ST
from mosaiq.operators import tables as T
from mosaiq.operators import tiling as TI
from mosaiq.operators import verbs as VB
from mosaiq.operators.stitch import stitch
from mosaiq.plans.graph import connected_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PX = {"y": 0.5, "x": 0.25}
CELL = {"x": 16.0, "y": 16.0}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def flat(df: DataFrame, *spans: str) -> DataFrame:
    """Span columns as <axis>_start, <axis>_len."""
    rest = [c for c in df.columns if c not in spans]
    return df.select(*rest, *[x for s in spans for x in (F.col(f"{s}.start").alias(f"{s}_start"), F.col(f"{s}.length").alias(f"{s}_len"))])


# -- objects ---------------------------------------------------------------------------------


@query(f"""WITH {V.LABELS} SELECT CAST(label AS BIGINT) AS label, CAST(label AS VARCHAR) AS name, min(y) * 0.5::DOUBLE AS y_start, (max(y) - min(y) + 1) * 0.5::DOUBLE AS y_len,
 min(x) * 0.25::DOUBLE AS x_start, (max(x) - min(x) + 1) * 0.25::DOUBLE AS x_len FROM label_grid WHERE label > 0 GROUP BY label""")
def masking_roi_table(spark, sf):
    return flat(L.bounding_boxes(V.label_grid(spark), ["y", "x"], PX), "y", "x")


@query(f"""WITH {V.PIXELS}, {V.LABELS} SELECT CAST(label AS BIGINT) AS label, c, count(*) AS area, round(avg(value), 6) AS mean, CAST(sum(value) AS DOUBLE) AS total,
 CAST(min(value) AS DOUBLE) AS low, CAST(max(value) AS DOUBLE) AS high, round(stddev_pop(value), 6) AS deviation FROM pixels JOIN label_grid USING (y, x) WHERE label > 0 GROUP BY label, c""")
def feature_measure(spark, sf):
    out = ST.measure(V.pixels(spark, sf), V.label_grid(spark), ["y", "x"], by=["c"])
    return out.withColumn("mean", F.round("mean", 6)).withColumn("deviation", F.round("deviation", 6))


@query(f"""WITH {V.PIXELS}, {V.LABELS}, a AS (SELECT y, x, label FROM label_grid WHERE label > 0), b AS (SELECT y, x, max(value) AS label FROM pixels GROUP BY y, x),
 s AS (SELECT a.label AS a, b.label AS b, count(*) AS shared FROM a JOIN b USING (y, x) WHERE b.label > 0 GROUP BY 1, 2),
 na AS (SELECT label, count(*) AS n FROM a GROUP BY label), nb AS (SELECT label, count(*) AS n FROM b WHERE label > 0 GROUP BY label)
 SELECT CAST(s.a AS BIGINT) AS a, CAST(s.b AS BIGINT) AS b, shared, round(shared / (na.n + nb.n - shared), 9) AS iou FROM s JOIN na ON na.label = s.a JOIN nb ON nb.label = s.b""")
def label_iou(spark, sf):
    other = V.pixels(spark, sf).groupBy("y", "x").agg(F.max("value").cast("long").alias("label"))
    return L.overlap_iou(V.label_grid(spark), other, ["y", "x"]).withColumn("iou", F.round("iou", 9))


@query(f"WITH {V.LABELS} SELECT y, x, CAST(CASE WHEN label > 0 THEN label + 1000 ELSE label END AS BIGINT) AS label FROM label_grid")
def offset_labels(spark, sf):
    return V.label_grid(spark).withColumn("label", L.offset(F.col("label"), F.lit(1000)))


@query(f"WITH {V.LABELS} SELECT y, x, CAST(CASE WHEN label > 0 AND label % 3 = 0 THEN 100 * label ELSE label END AS BIGINT) AS label FROM label_grid")
def relabel_map(spark, sf):
    mapping = spark.range(1, 257).where("id % 3 = 0").select(F.col("id").alias("old"), (F.col("id") * 100).alias("new"))
    return L.relabel(V.label_grid(spark), mapping)


@query(f"""WITH {V.LABELS}, seen AS (SELECT label AS old, min((y // 64) * 4 + x // 64) AS unit FROM label_grid WHERE label > 0 GROUP BY label)
 SELECT CAST(old AS BIGINT) AS "old", row_number() OVER (ORDER BY unit, old) AS "new" FROM seen""")
def relabel_sequential(spark, sf):
    unit = F.floor(F.col("y") / 64) * 4 + F.floor(F.col("x") / 64)
    return L.relabel_sequential(V.label_grid(spark), unit)


@query(f"""WITH {V.LABELS}, seen AS (SELECT label AS old, (label - 1) // 2 * 2 + 1 AS root, min((y // 64) * 4 + x // 64) AS unit FROM label_grid WHERE label > 0 GROUP BY label),
 place AS (SELECT root, min(unit * 100000 + old) AS p FROM seen GROUP BY root), num AS (SELECT root, row_number() OVER (ORDER BY p) AS n FROM place)
 SELECT CAST(old AS BIGINT) AS "old", n AS "new" FROM seen JOIN num USING (root)""")
def relabel_canonical(spark, sf):
    mapping = spark.range(1, 257).select(F.col("id").alias("old"), (F.floor((F.col("id") - 1) / 2) * 2 + 1).alias("new"))
    return L.relabel_sequential(V.label_grid(spark), F.floor(F.col("y") / 64) * 4 + F.floor(F.col("x") / 64), mapping)


@query(f"WITH {V.LABELS} SELECT y, x, CAST(CASE WHEN label > 0 THEN label + (y // 64) * 1000 ELSE label END AS BIGINT) AS label FROM label_grid")
def unique_labels(spark, sf):
    return V.label_grid(spark).withColumn("label", L.checked_offset(F.col("label"), 1000, F.floor(F.col("y") / 64)))


# -- regions ---------------------------------------------------------------------------------

_SNAP = "CASE WHEN abs(round_even({v}, 0) - {v}) < 0.01 THEN round_even({v}, 0) ELSE {v} END"


@query(f"""WITH {V.REGIONS} SELECT label, name, {_SNAP.format(v="(xs / 0.65)")} AS x_start, {_SNAP.format(v="(xl / 0.65)")} AS x_len,
 {_SNAP.format(v="(ys / 0.65)")} AS y_start, {_SNAP.format(v="(yl / 0.65)")} AS y_len FROM rois""")
def roi_to_pixel(spark, sf):
    r = V.event_regions(spark, sf)
    return flat(r.withColumn("x", R.to_pixel(F.col("x"), F.lit(0.65))).withColumn("y", R.to_pixel(F.col("y"), F.lit(0.65))), "x", "y")


@query(f"WITH {V.REGIONS} SELECT label, name, xs * 0.65::DOUBLE AS x_start, xl * 0.65::DOUBLE AS x_len, ys * 0.65::DOUBLE AS y_start, yl * 0.65::DOUBLE AS y_len FROM rois")
def roi_to_world(spark, sf):
    r = V.event_regions(spark, sf)
    return flat(r.withColumn("x", R.to_world(F.col("x"), F.lit(0.65))).withColumn("y", R.to_world(F.col("y"), F.lit(0.65))), "x", "y")


@query(f"""WITH {V.REGIONS} SELECT label, name, greatest(xs - xl * 0.5::DOUBLE / 2, 0) AS x_start, xl + xl * 0.5::DOUBLE AS x_len,
 greatest(ys - yl * 0.5::DOUBLE / 2, 0) AS y_start, yl + yl * 0.5::DOUBLE AS y_len FROM rois""")
def roi_zoom(spark, sf):
    r = V.event_regions(spark, sf)
    return flat(r.withColumn("x", R.zoom(F.col("x"), 1.5)).withColumn("y", R.zoom(F.col("y"), 1.5)), "x", "y")


@query(f"""WITH {V.REGIONS} SELECT split_part(name, '_', 1) AS kind, min(xs) AS x_start, max(xs + xl) - min(xs) AS x_len, min(ys) AS y_start, max(ys + yl) - min(ys) AS y_len FROM rois GROUP BY 1""")
def roi_union_all(spark, sf):
    r = V.event_regions(spark, sf).withColumn("kind", F.substring_index("name", "_", 1))
    low, high = (lambda a: F.min(R.low_of(F.col(a)))), (lambda a: F.max(R.high_of(F.col(a))))
    return r.groupBy("kind").agg(low("x").alias("x_start"), (high("x") - low("x")).alias("x_len"), low("y").alias("y_start"), (high("y") - low("y")).alias("y_len"))


@query(f"""WITH {V.REGIONS}, tiles AS (SELECT y0, x0, 'y' || y0 || '_x' || x0 AS tile FROM range(0, 256, 64) a(y0), range(0, 256, 64) b(x0))
 SELECT label, name || ':' || tile AS name, greatest(xs, x0) AS x_start, least(xs + xl, x0 + 64) - greatest(xs, x0) AS x_len,
 greatest(ys, y0) AS y_start, least(ys + yl, y0 + 64) - greatest(ys, y0) AS y_len FROM rois JOIN tiles ON xs < x0 + 64 AND x0 < xs + xl AND ys < y0 + 64 AND y0 < ys + yl""")
def roi_product_grid(spark, sf):
    tiles = TI.by_grid(spark.createDataFrame([(V.EDGE, V.EDGE)], "size_y int, size_x int"), {"y": 64, "x": 64})
    tiles = tiles.select("tile_name", *[x for a in ("x", "y") for x in (F.col(f"tile_{a}.start").cast("double").alias(f"{a}_start"), (F.col(f"tile_{a}.start") + F.col(f"tile_{a}.length")).cast("double").alias(f"{a}_stop"))])
    boxes = V.event_boxes(spark, sf).join(V.event_regions(spark, sf).select(F.col("label").alias("id"), "name"), "id")
    pairs = S.overlap_join(boxes, tiles, ["x", "y"], {"x": 64.0, "y": 64.0})
    out = pairs.select(F.col("a.id").alias("label"), R.joined_name(F.col("a.name"), F.col("b.tile_name")).alias("name"), *S.common_box(["x", "y"]))
    return out.select("label", "name", *[x for a in ("x", "y") for x in (F.col(f"{a}_start"), (F.col(f"{a}_stop") - F.col(f"{a}_start")).alias(f"{a}_len"))])


@query(f"""WITH {V.REGIONS}, w AS (SELECT label, name, floor(label % 7) * 20.0::DOUBLE AS ws, CASE WHEN label % 5 = 0 THEN NULL ELSE 60.0::DOUBLE END AS wl FROM rois),
 j AS (SELECT r.label, r.name, greatest(xs, ws) AS lo, least(CASE WHEN xs + xl = 0 THEN 'inf'::DOUBLE ELSE xs + xl END, coalesce(nullif(ws + wl, 0), 'inf'::DOUBLE)) AS hi, ys, yl FROM rois r JOIN w USING (label))
 SELECT label, name, lo AS x_start, hi - lo AS x_len, ys AS y_start, yl AS y_len FROM j WHERE lo < hi""")
def roi_intersection(spark, sf):
    """Regions with a window of their own, open at the end for some; the window has no y axis."""
    r = V.event_regions(spark, sf)
    window = R.span(F.floor(F.col("label") % 7) * 20.0, F.when(F.col("label") % 5 != 0, 60.0))
    r = r.withColumn("w", window).withColumn("none", R.no_span())
    cut = r.where(R.meets(F.col("x"), F.col("w")) & R.meets(F.col("y"), F.col("none")))
    return flat(cut.select("label", "name", R.meet(F.col("x"), F.col("w")).alias("x"), R.meet(F.col("y"), F.col("none")).alias("y")), "x", "y")


@query(f"""WITH {V.REGIONS} SELECT label, name, (floor(xs / 0.5) + 3) * 0.5::DOUBLE AS x_start, 2.0::DOUBLE AS x_len, ys AS y_start, yl AS y_len FROM rois""")
def roi_anchor(spark, sf):
    """A box of four pixels found three pixels into each region's patch; its y axis is the region's."""
    r = V.event_regions(spark, sf)
    local = R.span(F.lit(3.0), F.lit(4.0))
    x, y = R.anchor(F.col("x"), local, F.lit(0.5)), R.anchor(F.col("y"), R.no_span(), F.lit(0.5))
    return flat(r.select("label", "name", x.alias("x"), y.alias("y")), "x", "y")


@query(f"""WITH {V.REGIONS} SELECT label, CAST(least(greatest(floor(xs), 0), 128) AS INTEGER) AS first, CAST(least(greatest(ceil(xs + xl), 0), 128) AS INTEGER) AS stop,
 CAST(greatest(least(xs, 128) - 8, 0) AS INTEGER) AS h_first, CAST(least(least(xs + xl, 128) + 8, 128) AS INTEGER) AS h_stop FROM rois""")
def halo_clip(spark, sf):
    r = V.event_regions(spark, sf).withColumn("s", R.to_slice(F.col("x"), F.lit(128)))
    r = r.withColumn("h", R.halo(F.col("s.first"), F.col("s.stop"), 8, F.lit(128)))
    return r.select("label", "s.first", "s.stop", F.col("h.first").alias("h_first"), F.col("h.stop").alias("h_stop"))


#: Pairs of boxes in SQL: those that share the cell in which their common box begins are compared.
_CELLS = f"""{V.BOXES}, xs AS (SELECT *, unnest(range(CAST(floor(x_start / 16) AS BIGINT), CAST(floor(x_stop / 16) AS BIGINT) + 1)) AS cx FROM boxes),
 cells AS (SELECT *, unnest(range(CAST(floor(y_start / 16) AS BIGINT), CAST(floor(y_stop / 16) AS BIGINT) + 1)) AS cy FROM xs)"""
_FIRST_CELL = "a.cx = b.cx AND a.cy = b.cy AND a.id < b.id AND a.cx = floor(greatest(a.x_start, b.x_start) / 16) AND a.cy = floor(greatest(a.y_start, b.y_start) / 16)"


@query(f"""WITH {_CELLS} SELECT a.id AS a, b.id AS b, greatest(a.x_start, b.x_start) AS x_start, least(a.x_stop, b.x_stop) AS x_stop,
 greatest(a.y_start, b.y_start) AS y_start, least(a.y_stop, b.y_stop) AS y_stop FROM cells a JOIN cells b ON {_FIRST_CELL}
 AND a.x_start < b.x_stop AND b.x_start < a.x_stop AND a.y_start < b.y_stop AND b.y_start < a.y_stop""")
def overlap_pairs(spark, sf):
    """All pairs of overlapping boxes."""
    pairs = S.overlap_pairs(V.event_boxes(spark, sf), "id", ["x", "y"], CELL)
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), *S.common_box(["x", "y"]))


@query(f"""WITH {_CELLS}, kinds AS (SELECT event_id AS id, event_type AS kind FROM events)
 SELECT a.id AS a, b.id AS b, ka.kind AS kind FROM cells a JOIN cells b ON {_FIRST_CELL} AND a.x_start < b.x_stop AND b.x_start < a.x_stop AND a.y_start < b.y_stop AND b.y_start < a.y_stop
 JOIN kinds ka ON ka.id = a.id JOIN kinds kb ON kb.id = b.id WHERE ka.kind = kb.kind""")
def compatible_pairs(spark, sf):
    """Overlapping boxes whose labels agree: events of one type."""
    kinds = V.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    pairs = S.overlap_pairs(V.event_boxes(spark, sf).join(kinds, "id"), "id", ["x", "y"], CELL, S.labels_compatible(F.col("a.kind"), F.col("b.kind")))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.kind").alias("kind"))


@query(f"""WITH {_CELLS} SELECT a.id AS ka, b.id AS kb FROM cells a JOIN cells b ON {_FIRST_CELL}
 AND (a.x_stop = b.x_start OR b.x_stop = a.x_start) AND a.y_start < b.y_stop AND b.y_start < a.y_stop""")
def touching_pairs(spark, sf):
    """All pairs of boxes that touch along x and overlap along y."""
    return S.touching_only(V.event_boxes(spark, sf), "id", ["x", "y"], CELL, "x")


@query(f"""WITH {V.BOXES} SELECT id, CAST(floor(x_start / 32) AS INTEGER) AS x_first, CAST(floor((x_stop - 1) / 32) AS INTEGER) AS x_last,
 CAST(floor(y_start / 32) AS INTEGER) AS y_first, CAST(floor((y_stop - 1) / 32) AS INTEGER) AS y_last FROM boxes""")
def chunk_footprint(spark, sf):
    rect = lambda a: R.chunk_rect(F.col(f"{a}_start"), F.col(f"{a}_stop"), F.lit(32))
    return V.event_boxes(spark, sf).select("id", rect("x").alias("rx"), rect("y").alias("ry")).select(
        "id", F.col("rx.first").alias("x_first"), F.col("rx.last").alias("x_last"), F.col("ry.first").alias("y_first"), F.col("ry.last").alias("y_last")
    )


@query(f"""WITH {V.BOXES}, cells AS (SELECT id, unnest(range(CAST(floor(x_start / 32) AS BIGINT), CAST(floor((x_stop - 1) / 32) AS BIGINT) + 1)) AS cx, y_start, y_stop FROM boxes),
 cell AS (SELECT id, cx, unnest(range(CAST(floor(y_start / 32) AS BIGINT), CAST(floor((y_stop - 1) / 32) AS BIGINT) + 1)) AS cy FROM cells)
 SELECT cx, cy, count(*) AS writers FROM cell GROUP BY cx, cy HAVING count(*) > 1""")
def chunk_conflicts(spark, sf):
    """Chunks that several boxes write."""
    b = V.event_boxes(spark, sf)
    cells = lambda a: F.explode(F.sequence(F.floor(F.col(f"{a}_start") / 32), F.floor((F.col(f"{a}_stop") - 1) / 32)))
    return b.withColumn("cx", cells("x")).withColumn("cy", cells("y")).groupBy("cx", "cy").agg(F.count("*").alias("writers")).where("writers > 1")


# -- tiles -----------------------------------------------------------------------------------

_DIMS = "dims AS (SELECT CAST(40 + n_nationkey * 7 AS INTEGER) AS dim, n_nationkey AS image FROM nation)"


def _dims(spark, sf):
    return V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("image"), (40 + F.col("n_nationkey") * 7).cast("int").alias("size_x"))


def _tiles(spark, sf, tail, stride=None):
    tiles = TI.by_grid(_dims(spark, sf), {"x": 32}, {"x": stride} if stride else None, tail)
    return tiles.select("image", F.col("tile_x.start").alias("start"), F.col("tile_x.length").alias("length"), "tile_name")


@query(f"WITH {_DIMS}, s AS (SELECT image, dim, unnest(range(0, dim, 24)) AS s FROM dims) SELECT image, CAST(s AS INTEGER) AS start, CAST(least(32, dim - s) AS INTEGER) AS length, 'x' || s AS tile_name FROM s")
def grid_tiles_clip(spark, sf):
    return _tiles(spark, sf, "clip", 24)


@query(f"""WITH {_DIMS}, s AS (SELECT image, dim, unnest(range(0, dim, 24)) AS s FROM dims)
 SELECT DISTINCT image, CAST(least(s, greatest(dim - 32, 0)) AS INTEGER) AS start, CAST(least(32, dim) AS INTEGER) AS length, 'x' || least(s, greatest(dim - 32, 0)) AS tile_name FROM s""")
def grid_tiles_shift(spark, sf):
    return _tiles(spark, sf, "shift", 24)


@query(f"WITH {_DIMS}, s AS (SELECT image, dim, unnest(range(0, dim, 32)) AS s FROM dims) SELECT image, CAST(s AS INTEGER) AS start, 32 AS length, 'x' || s AS tile_name FROM s WHERE s + 32 <= dim")
def grid_tiles_drop(spark, sf):
    return _tiles(spark, sf, "drop")


@query(f"""WITH {_DIMS}, s AS (SELECT image, dim, unnest(range(0, dim, 32)) AS s, (dim - 1) // 32 AS k FROM dims),
 b AS (SELECT *, dim - (k - 1) * 32 AS total, dim % 32 <> 0 AND k > 0 AS uneven FROM s)
 SELECT image, CAST(CASE WHEN uneven AND s = k * 32 THEN (k - 1) * 32 + (total + 1) // 2 ELSE s END AS INTEGER) AS start,
 CAST(CASE WHEN uneven AND s = k * 32 THEN total - (total + 1) // 2 WHEN uneven AND s = (k - 1) * 32 THEN (total + 1) // 2 ELSE least(32, dim - s) END AS INTEGER) AS length,
 'x' || CASE WHEN uneven AND s = k * 32 THEN (k - 1) * 32 + (total + 1) // 2 ELSE s END AS tile_name FROM b""")
def grid_tiles_balance(spark, sf):
    return _tiles(spark, sf, "balance")


@query(f"""WITH {_DIMS}, s AS (SELECT image, dim, unnest(range(0, 7)) AS i FROM dims)
 SELECT image, CAST(i * (dim // 7) + least(i, dim % 7) AS INTEGER) AS start, CAST(dim // 7 + CASE WHEN i < dim % 7 THEN 1 ELSE 0 END AS INTEGER) AS length FROM s""")
def blocks_partition(spark, sf):
    tiles = TI.by_blocks(_dims(spark, sf), {"x": 7})
    return tiles.select("image", F.col("tile_x.start").alias("start"), F.col("tile_x.length").alias("length"))


@query("""WITH dims AS (SELECT n_nationkey AS image, 1 + n_nationkey % 3 AS t, 1 + n_nationkey % 4 AS z FROM nation)
 SELECT image, CAST(tt * z + zz AS BIGINT) AS tile_index, 't' || tt || '_z' || zz || '_y0_x0' AS tile_name FROM dims, range(3) a(tt), range(4) b(zz) WHERE tt < t AND zz < z""")
def planes_by_yx(spark, sf):
    n = V.table(spark, sf, "nation")
    dims = n.select(F.col("n_nationkey").alias("image"), (1 + F.col("n_nationkey") % 3).alias("size_t"), (1 + F.col("n_nationkey") % 4).alias("size_z"), F.lit(64).alias("size_y"), F.lit(64).alias("size_x"))
    return TI.by_yx(dims).select("image", "tile_index", "tile_name")


@query("""WITH dims AS (SELECT n_nationkey AS image, 40 + n_nationkey * 7 AS dim, 8 * (1 + n_nationkey % 4) AS chunk FROM nation)
 SELECT image, CAST(s AS INTEGER) AS start, CAST(least(chunk, dim - s) AS INTEGER) AS length FROM (SELECT image, dim, chunk, unnest(range(0, dim, chunk - 2)) AS s FROM dims)""")
def storage_unit_tiles(spark, sf):
    dims = _dims(spark, sf).withColumn("chunk_x", (8 * (1 + F.col("image") % 4)).cast("int"))
    return TI.by_storage_units(dims, {"x": 2}).select("image", F.col("tile_x.start").alias("start"), F.col("tile_x.length").alias("length"))


@query("SELECT event_id AS unit, event_id // 32 AS batch, event_id % 32 AS place FROM events")
def batch_assign(spark, sf):
    return TI.batches(V.table(spark, sf, "events").select(F.col("event_id").alias("unit")), "unit", 32)


# -- pixels ----------------------------------------------------------------------------------


@query(f"WITH {V.PIXELS} SELECT y, x, value FROM pixels WHERE c = 1 AND y >= 10 AND y < 101 AND x IN (3, 17, 200)")
def slice_selection(spark, sf):
    return P.select(V.pixels(spark, sf), {"c": 3, "y": 256, "x": 256}, c=1, y=slice(10.5, 100.2), x=[200, 3, 17])


@query(f"""WITH {V.PIXELS}, {V.REGIONS} SELECT label, c, y, x, value FROM rois JOIN pixels ON x >= floor(xs) AND x < ceil(xs + xl) AND y >= floor(ys) AND y < ceil(ys + yl)""")
def region_pixels(spark, sf):
    regions = V.event_regions(spark, sf).select("label", "x", "y")
    return P.select_regions(V.pixels(spark, sf), regions, ["y", "x"], {}, {"y": 256, "x": 256}).select("label", "c", "y", "x", "value")


@query(f"WITH {V.PIXELS}, {V.LABELS} SELECT c, y, x, CASE WHEN label = 37 THEN value ELSE -1 END AS value FROM pixels JOIN label_grid USING (y, x)")
def mask_fill(spark, sf):
    return P.mask_fill(V.pixels(spark, sf), V.label_grid(spark), ["y", "x"], 37, -1)


_PATCH = "patch AS (SELECT c, y, x, CASE WHEN (x + y) % 4 = 0 THEN 0 ELSE 51 - value END AS value FROM pixels WHERE y < 128 AND c = 0)"


def _write(spark, sf, rule, mask=None):
    image = V.pixels(spark, sf)
    patch = image.where("y < 128 and c = 0").withColumn("value", F.when((F.col("x") + F.col("y")) % 4 == 0, 0).otherwise(51 - F.col("value")))
    return P.write(image, patch, ["c", "y", "x"] if mask is None else ["c", "y", "x"], rule, "uint8" if rule == "sum" else None).withColumn("value", F.col("value").cast("long"))


def _write_sql(expr):
    return f"WITH {V.PIXELS}, {_PATCH} SELECT i.c, i.y, i.x, CAST(CASE WHEN p.value IS NULL THEN i.value ELSE {expr} END AS BIGINT) AS value FROM pixels i LEFT JOIN patch p ON i.c = p.c AND i.y = p.y AND i.x = p.x"


@query(_write_sql("greatest(i.value, p.value)"))
def merge_max(spark, sf):
    return _write(spark, sf, "max")


@query(_write_sql("least(i.value, p.value)"))
def merge_min(spark, sf):
    return _write(spark, sf, "min")


@query(_write_sql("(i.value + p.value) % 256"))
def merge_sum(spark, sf):
    return _write(spark, sf, "sum")


@query(_write_sql("CASE WHEN p.value <> 0 THEN p.value ELSE i.value END"))
def merge_keep_nonzero(spark, sf):
    return _write(spark, sf, "keep_nonzero")


@query(f"""WITH {V.PIXELS}, {V.LABELS}, f AS (SELECT y, x, max(value) AS value FROM pixels GROUP BY y, x), p AS (SELECT y, x, 51 - value AS value FROM f JOIN label_grid USING (y, x) WHERE y < 128 AND label <> 0)
 SELECT f.y, f.x, coalesce(p.value, f.value) AS value FROM f LEFT JOIN p ON f.y = p.y AND f.x = p.x""")
def mask_merge(spark, sf):
    image = V.pixels(spark, sf).groupBy("y", "x").agg(F.max("value").alias("value"))
    patch = image.where("y < 128").withColumn("value", 51 - F.col("value"))
    return P.write(image, patch, ["y", "x"], mask=V.label_grid(spark))


@query(f"WITH {V.PIXELS} SELECT c, CAST(i AS INTEGER) AS y, CAST(j AS INTEGER) AS x, value FROM pixels, range(2) a(dy), range(2) b(dx), LATERAL (SELECT 2 * y + dy AS i, 2 * x + dx AS j)")
def zoom_nearest_up(spark, sf):
    return P.nearest_zoom(V.pixels(spark, sf), {"y": 2.0, "x": 2.0}, {"y": 512, "x": 512})


@query(f"WITH {V.PIXELS} SELECT c, CAST((y - 1) // 2 AS INTEGER) AS y, CAST((x - 1) // 2 AS INTEGER) AS x, value FROM pixels WHERE y % 2 = 1 AND x % 2 = 1")
def zoom_nearest_down(spark, sf):
    return P.nearest_zoom(V.pixels(spark, sf), {"y": 0.5, "x": 0.5}, {"y": 128, "x": 128})


@query(f"WITH {V.PIXELS} SELECT c, y // 64 AS cy, x // 64 AS cx, count(*) AS n, sum(value) AS total FROM pixels GROUP BY 1, 2, 3")
def chunk_round_trip(spark, sf):
    """Pixels into chunks and back again."""
    size = {"y": 64, "x": 64}
    back = P.from_chunks(P.to_chunks(V.pixels(spark, sf), ["y", "x"], size, ["c"]), ["y", "x"], size, ["c"])
    return back.groupBy("c", F.floor(F.col("y") / 64).cast("int").alias("cy"), F.floor(F.col("x") / 64).cast("int").alias("cx")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"WITH {V.PIXELS}, shown AS (SELECT c, CAST(value AS DOUBLE) AS v, row_number() OVER (PARTITION BY c ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY c) AS n FROM pixels WHERE value > 1e-16) SELECT c, max(CASE WHEN r = CAST(round_even(0.01::DOUBLE * (n - 1), 0) AS BIGINT) THEN v END) AS p0, max(CASE WHEN r = CAST(round_even(0.5::DOUBLE * (n - 1), 0) AS BIGINT) THEN v END) AS p1, max(CASE WHEN r = CAST(round_even(0.99::DOUBLE * (n - 1), 0) AS BIGINT) THEN v END) AS p2 FROM shown GROUP BY c")
def channel_percentiles(spark, sf):
    return ST.percentiles(V.pixels(spark, sf), [1, 50, 99])


@query(f"""WITH {V.PIXELS}, w(d, k) AS (VALUES (-1, 0.25::DOUBLE), (0, 0.75::DOUBLE), (1, 0.75::DOUBLE), (2, 0.25::DOUBLE))
 SELECT c, CAST(2 * y + a.d AS INTEGER) AS y, CAST(2 * x + b.d AS INTEGER) AS x, round(sum(value * a.k * b.k), 6) AS value FROM pixels, w a, w b
 WHERE 2 * y + a.d BETWEEN 0 AND 511 AND 2 * x + b.d BETWEEN 0 AND 511 GROUP BY 1, 2, 3""")
def zoom_linear_up(spark, sf):
    return P.linear_zoom(V.pixels(spark, sf), {"y": 2.0, "x": 2.0}, {"y": 512, "x": 512}).withColumn("value", F.round("value", 6))


@query(f"""WITH {V.PIXELS}, k AS (SELECT 1)
 SELECT c, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, round(sum(value) * 0.25::DOUBLE, 6) AS value FROM pixels GROUP BY 1, 2, 3""")
def zoom_linear_down(spark, sf):
    """Halving: a target's centre lies between two source pixels of each axis, which count half each."""
    return P.linear_zoom(V.pixels(spark, sf), {"y": 0.5, "x": 0.5}, {"y": 128, "x": 128}).withColumn("value", F.round("value", 6))


@query(f"""WITH {V.PIXELS}, {V.LABELS} SELECT p.c, p.y, p.x, CASE WHEN l.label <> 0 THEN value ELSE 0 END AS value FROM pixels p JOIN label_grid l ON l.y = p.y // 2 AND l.x = p.x // 2""")
def mask_other_scale(spark, sf):
    """Labels of half the resolution as the mask."""
    return P.mask_fill_scaled(V.pixels(spark, sf), V.label_grid(spark), {"y": 0.5, "x": 0.5}, None)


@query(f"""WITH {V.PIXELS} SELECT c, CAST(k * 256 + CASE WHEN k % 2 = 0 THEN y ELSE 255 - y END AS INTEGER) AS y, CAST(x - 78 AS INTEGER) AS x, value FROM pixels, range(3) r(k)
 WHERE k * 256 + CASE WHEN k % 2 = 0 THEN y ELSE 255 - y END < 600 AND x BETWEEN 78 AND 177""")
def fit_mirrored(spark, sf):
    """The centre along x, mirrored repetitions along y."""
    return P.fit_to_shape(V.pixels(spark, sf), {"y": 256, "x": 256}, {"y": 600, "x": 100}).select("c", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "value")


@query(f"""WITH {V.LABELS} SELECT CAST(k * 256 + CASE WHEN k % 2 = 0 THEN y ELSE 255 - y END AS INTEGER) AS y, x, CAST(CASE WHEN label > 0 THEN label + k * 256 ELSE 0 END AS BIGINT) AS label
 FROM label_grid, range(2) r(k) WHERE k * 256 + CASE WHEN k % 2 = 0 THEN y ELSE 255 - y END < 400""")
def fit_mirrored_labels(spark, sf):
    """Repetitions of a label image have ids of their own."""
    out = P.fit_to_shape(V.label_grid(spark), {"y": 256, "x": 256}, {"y": 400, "x": 256}, "label", unique=True)
    return out.select(F.col("y").cast("int").alias("y"), "x", "label")


@query(_write_sql("greatest(i.value, p.value) - least(i.value, p.value)"))
def merge_custom(spark, sf):
    """A write with a rule of the user: the difference of both values."""
    return _write(spark, sf, lambda old, new: F.abs(new - old))


@query(f"WITH {V.PIXELS} SELECT c, y, x, CAST((value * 2 + 1) % 17 AS BIGINT) AS value FROM pixels WHERE (value * 2 + 1) % 17 <> 3")
def transform_chain(spark, sf):
    """Steps of the user between reading and writing."""
    steps = [lambda d: d.withColumn("value", F.col("value") * 2 + 1), lambda d: d.withColumn("value", (F.col("value") % 17).cast("long")), lambda d: d.where("value <> 3")]
    return P.transformed(V.pixels(spark, sf), steps)


# -- pyramid ---------------------------------------------------------------------------------


@query(f"WITH {V.PIXELS} SELECT c, y // 2 AS y, x // 2 AS x, round(sum(value) / 4.0::DOUBLE, 6) AS value FROM pixels GROUP BY 1, 2, 3")
def coarsen_mean(spark, sf):
    return Y.coarsen(V.pixels(spark, sf), {"y": 2, "x": 2}, {"y": 256, "x": 256}).withColumn("value", F.round("value", 6))


@query(f"WITH {V.LABELS} SELECT y // 3 AS y, x // 3 AS x, CAST(max(label) AS BIGINT) AS label FROM label_grid WHERE y < 255 AND x < 255 GROUP BY 1, 2")
def coarsen_max(spark, sf):
    out = Y.coarsen(V.label_grid(spark).withColumnRenamed("label", "value"), {"y": 3, "x": 3}, {"y": 256, "x": 256}, "max")
    return out.withColumnRenamed("value", "label")


@query(f"""WITH {V.PIXELS}, l1 AS (SELECT c, y // 2 AS y, x // 2 AS x, CAST(sum(value) // 4 AS BIGINT) AS value FROM pixels GROUP BY 1, 2, 3)
 SELECT c, y // 2 AS y, x // 2 AS x, CAST(sum(value) // 4 AS BIGINT) AS value FROM l1 GROUP BY 1, 2, 3""")
def pyramid_level_2(spark, sf):
    return Y.build(V.pixels(spark, sf), {"y": 2, "x": 2}, {"y": 256, "x": 256}, 3, dtype="uint16")[2]


@query(f"""WITH {V.PIXELS}, now AS (SELECT c, y, x, CASE WHEN y >= 10 AND y < 31 AND x >= 40 AND x < 77 THEN value + 100 ELSE value END AS value FROM pixels)
 SELECT c, y // 2 AS y, x // 2 AS x, round(sum(value) / 4.0::DOUBLE, 6) AS value FROM now GROUP BY 1, 2, 3""")
def pyramid_refresh(spark, sf):
    """A level after a write to one region, made again from the blocks it reaches only."""
    sizes, factor = {"y": 256, "x": 256}, {"y": 2, "x": 2}
    old = V.pixels(spark, sf)
    region = {"y": (10, 31), "x": (40, 77)}
    new = old.withColumn("value", F.when(Y.within([region]), F.col("value") + 100).otherwise(F.col("value")))
    out = Y.refresh(new, Y.coarsen(old, factor, sizes), [region], factor, sizes, {"y": 16, "x": 16})
    return out.withColumn("value", F.round("value", 6))


@query("""WITH RECURSIVE l AS (SELECT 0 AS level, 10 AS z, 541 AS y, 300 AS x, 1.0::DOUBLE AS pz, 0.5::DOUBLE AS py, 0.25::DOUBLE AS px
 UNION ALL SELECT level + 1, z, greatest(1, y // 2), greatest(1, x // 2), pz, py * y / greatest(1, y // 2), px * x / greatest(1, x // 2) FROM l WHERE level < 5)
 SELECT 'image' AS image, level, z AS size_z, y AS size_y, x AS size_x, pz AS px_z, py AS px_y, px AS px_x FROM l""")
def pyramid_levels(spark, sf):
    return Y.levels_table(spark, "image", {"z": 10, "y": 541, "x": 300}, {"z": 1.0, "y": 0.5, "x": 0.25}, {"y": 2.0, "x": 2.0}, 6)


@query("""WITH l AS (SELECT n_nationkey AS image, k AS level, (1 + n_nationkey % 5) * 0.1::DOUBLE * (1 << k) AS px_y, (1 + n_nationkey % 5) * 0.1::DOUBLE * (1 << k) AS px_x FROM nation, range(5) a(k)),
 d AS (SELECT image, level, sqrt((px_y - 0.65) * (px_y - 0.65) + (px_x - 0.65) * (px_x - 0.65)) AS distance FROM l)
 SELECT image, CAST(level AS INTEGER) AS level, round(distance, 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY distance, level) AS r FROM d) WHERE r = 1""")
def nearest_level(spark, sf):
    levels = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("level"))
    px = (1 + F.col("image") % 5) * 0.1 * F.pow(F.lit(2.0), F.col("level"))
    found = Y.nearest_level(levels.withColumn("px_y", px).withColumn("px_x", px), {"y": 0.65, "x": 0.65})
    return found.withColumn("distance", F.round("distance", 9))


# -- tables and plates -----------------------------------------------------------------------

_CUST = f"WITH {V.PLATE}, t AS (SELECT c_custkey AS label, c_acctbal AS balance, c_mktsegment AS segment, \"row\", \"column\", path_in_well, acquisition FROM customer JOIN plate ON c_nationkey = nation)"


def _customers(spark, sf):
    c, p = V.table(spark, sf, "customer"), V.plate_images(spark, sf)
    return c.join(p, F.col("c_nationkey") == F.col("nation")).select(F.col("c_custkey").alias("label"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), "row", "column", "path_in_well", "acquisition")


@query(_CUST + """ SELECT label, balance, segment, "row", "column", path_in_well, "row" || '_' || "column" || '_' || path_in_well || '_' || label AS "index" FROM t""")
def concat_tables_lazy(spark, sf):
    return T.concat_catalog(_customers(spark, sf).drop("acquisition"), ["row", "column", "path_in_well"], "index")


@query(_CUST + """ SELECT label, balance, CASE WHEN acquisition = 0 THEN segment END AS segment, CAST(acquisition AS VARCHAR) AS acq, CAST(acquisition AS VARCHAR) || '_' || label AS "index" FROM t""")
def concat_tables_eager(spark, sf):
    """The tables of three acquisitions, the first with a column more."""
    t = _customers(spark, sf)
    first = t.where("acquisition = 0").select("label", "balance", "segment")
    others = [(t.where(f"acquisition = {a}").select("label", "balance"), {"acq": str(a)}) for a in (1, 2)]
    return T.concat([(first, {"acq": "0"}), *others], "index", lazy=False)


_CAT = "cat AS (SELECT DISTINCT c_nationkey AS image, c_mktsegment AS name, CASE WHEN c_mktsegment < 'C' THEN 'roi_table' ELSE 'feature_table' END AS kind FROM customer WHERE c_acctbal > 6000)"


def _catalog(spark, sf):
    c = V.table(spark, sf, "customer").where("c_acctbal > 6000")
    return c.select(F.col("c_nationkey").alias("image"), F.col("c_mktsegment").alias("name"), F.when(F.col("c_mktsegment") < "C", "roi_table").otherwise("feature_table").alias("kind")).distinct()


@query(f"WITH {_CAT} SELECT name FROM cat GROUP BY name HAVING count(DISTINCT image) = (SELECT count(DISTINCT image) FROM cat)")
def list_tables_common(spark, sf):
    return T.list_names(_catalog(spark, sf), "common")


@query(f"WITH {_CAT} SELECT DISTINCT name FROM cat WHERE kind = 'feature_table'")
def list_tables_all(spark, sf):
    return T.list_names(_catalog(spark, sf), "all", ["feature_table"])


@query(f"""WITH {V.REGIONS} SELECT name, label, xs AS x_micrometer, xl AS len_x_micrometer, ys AS y_micrometer, yl AS len_y_micrometer, 0.0::DOUBLE AS z_micrometer, 1.0::DOUBLE AS len_z_micrometer FROM rois""")
def roi_table_round_trip(spark, sf):
    return T.from_regions(T.to_regions(T.from_regions(V.event_regions(spark, sf))))


@query("SELECT event_id, CASE WHEN r > 1 THEN event_type || '_' || r ELSE event_type END AS name FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events)")
def unique_roi_names(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", F.col("event_type").alias("name"))
    return T.unique_names(e, "name", "event_id")


@query("""SELECT c_custkey AS label, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_acctbal END AS balance FROM customer UNION ALL SELECT -c_custkey, 0 FROM customer WHERE c_custkey % 100 = 4""")
def table_upsert(spark, sf):
    old = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("label"), F.col("c_acctbal").alias("balance"))
    new = old.where("label % 4 = 0").withColumn("balance", F.lit(0.0))
    return T.upsert(old, new.unionByName(old.where("label % 100 = 4").select((-F.col("label")).alias("label"), F.lit(0.0).alias("balance"))), "label", overwrite=True)


@query(f"""WITH {V.PLATE} SELECT "row", "column", path_in_well, "row" || '/' || "column" || '/' || path_in_well AS path FROM plate WHERE acquisition = 1""")
def acquisition_filter(spark, sf):
    return PL.images(V.plate_images(spark, sf), acquisition=1).select("row", "column", "path_in_well", "path")


@query(f"""WITH {V.PLATE}, w AS (SELECT DISTINCT "row", "column" FROM plate)
 SELECT 'plate' AS plate, "row", "column", dense_rank() OVER (ORDER BY "row") - 1 AS row_index, dense_rank() OVER (ORDER BY "column") - 1 AS column_index, "row" || '/' || "column" AS path FROM w""")
def plate_wells(spark, sf):
    return PL.wells(V.plate_images(spark, sf))


# -- graphs, detection, stitching ------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS a, c_custkey + 1 + c_custkey % 7 AS b FROM customer),
 edges AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS node, a AS seen FROM edges UNION SELECT r.node, x.b FROM reach r JOIN edges x ON x.a = r.seen)
 SELECT node, min(seen) AS component FROM reach GROUP BY node""")
def components_min_label(spark, sf):
    """Components over the links of all customers."""
    c = V.table(spark, sf, "customer")
    return connected_components(c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1 + F.col("c_custkey") % 7).alias("b")))


#: Greedy choice in SQL over boxes (node, c: component, k: rank within it) and their overlaps (n, m): one step for each rank of a component.
_GREEDY = """near AS (SELECT n, list(m) AS l FROM edges GROUP BY n),
 steps AS (SELECT node, c, k, coalesce(l, []::BIGINT[]) AS l FROM placed LEFT JOIN near ON n = node),
 chosen(c, k, kept) AS (SELECT DISTINCT c, 0::BIGINT, []::BIGINT[] FROM steps
 UNION ALL SELECT s.c, s.k, CASE WHEN list_has_any(kept, s.l) THEN kept ELSE list_append(kept, s.node) END FROM chosen h JOIN steps s ON s.c = h.c AND s.k = h.k + 1),
 stay AS (SELECT unnest(arg_max(kept, k)) AS node FROM chosen GROUP BY c)"""


@query(f"""WITH RECURSIVE {_CELLS}, e AS (SELECT event_id, event_type AS kind, value AS score FROM events),
 pairs AS (SELECT a.id AS a, b.id AS b, (least(a.x_stop, b.x_stop) - greatest(a.x_start, b.x_start)) * (least(a.y_stop, b.y_stop) - greatest(a.y_start, b.y_start)) AS common,
 (a.x_stop - a.x_start) * (a.y_stop - a.y_start) + (b.x_stop - b.x_start) * (b.y_stop - b.y_start) AS sizes FROM cells a JOIN cells b ON {_FIRST_CELL}
 AND a.x_start < b.x_stop AND b.x_start < a.x_stop AND a.y_start < b.y_stop AND b.y_start < a.y_stop),
 alike AS (SELECT a, b FROM pairs JOIN e x ON x.event_id = a JOIN e y ON y.event_id = b WHERE x.kind IS NOT DISTINCT FROM y.kind AND common / (sizes - common) >= 0.5),
 edges AS (SELECT a AS n, b AS m FROM alike UNION ALL SELECT b, a FROM alike),
 reach(node, seen) AS (SELECT n, n FROM edges UNION SELECT m, seen FROM reach JOIN edges ON n = node WHERE seen < m),
 parts AS (SELECT node, min(seen) AS c FROM reach GROUP BY node),
 placed AS (SELECT node, c, row_number() OVER (PARTITION BY c ORDER BY score DESC, node) AS k FROM parts JOIN e ON event_id = node),
 {_GREEDY}
 SELECT x_start, x_stop, y_start, y_stop, score, kind AS event_type, id // 100 AS tile, CAST(id % 100 AS INTEGER) AS "row", row_number() OVER (ORDER BY id) AS id
 FROM boxes b JOIN e ON event_id = b.id WHERE b.id NOT IN (SELECT node FROM parts) OR b.id IN (SELECT node FROM stay)""")
def nms_boxes(spark, sf):
    """Kept boxes of events, the value as the score and the type as the group."""
    e = V.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score"), "event_type")
    boxes = V.event_boxes(spark, sf).join(e.hint("merge"), "id").withColumn("tile", F.floor(F.col("id") / 100).cast("long")).withColumn("row", (F.col("id") % 100).cast("int")).drop("id")
    return VB.suppress(boxes, ["x", "y"], 0.5, "score", ["event_type"], CELL)


@query(f"""WITH {V.PIXELS} SELECT y, x, CAST(max(value) AS DOUBLE) * 2 + 1 AS value FROM pixels GROUP BY y, x
 UNION ALL SELECT CAST(y AS INTEGER), CAST(x AS INTEGER), 1.0::DOUBLE FROM range(256) a(y), range(256) b(x) WHERE (y, x) NOT IN (SELECT (y, x) FROM pixels)""")
def map_tiles(spark, sf):
    """A user's function of the largest value over all channels, over 64 x 64 tiles with a halo of 4; missing pixels are 0."""
    image = _flat_image(spark, sf)
    return VB.map_tiles(image, _halo_tiles(spark), lambda a: a * 2 + 1, ["y", "x"]).select("y", "x", "value")


def _flat_image(spark, sf):
    return V.pixels(spark, sf).groupBy("y", "x").agg(F.max("value").cast("double").alias("value"))


def _halo_tiles(spark, edge=V.EDGE, size=64, margin=4):
    tiles = TI.by_grid(spark.createDataFrame([(edge, edge)], "size_y int, size_x int"), {"y": size, "x": size})
    return TI.tile_extents(tiles, ["y", "x"], {"y": edge, "x": edge}, margin)


_FLAT = "flat AS (SELECT y, x, max(value) AS value FROM pixels GROUP BY y, x), every AS (SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM range(256) a(y), range(256) b(x))"


@query(f"""WITH {V.PIXELS}, {_FLAT} SELECT e.y, e.x, CAST(CASE WHEN f.value > 25 THEN (e.y // 64) * 4 + e.x // 64 + 1 ELSE 0 END AS BIGINT) AS label
 FROM every e LEFT JOIN flat f ON e.y = f.y AND e.x = f.x""")
def segment_tiles(spark, sf):
    """A user's segmentation per tile; its ids are made unique by tile."""
    return VB.segment(_flat_image(spark, sf), _halo_tiles(spark), lambda a: (a > 25).astype(int), ["y", "x"], 1)


@query(f"""WITH {V.PIXELS}, {_FLAT}, {V.LABELS} SELECT l.y, l.x, CAST(CASE WHEN f.value > 25 THEN l.label * 10 + 1 ELSE 0 END AS BIGINT) AS label
 FROM label_grid l LEFT JOIN flat f ON l.y = f.y AND l.x = f.x WHERE l.label <> 0""")
def segment_objects(spark, sf):
    """A user's segmentation within each object."""
    return VB.segment_masked(_flat_image(spark, sf), V.label_grid(spark), lambda a: (a > 25).astype(int), ["y", "x"], 10)


@query(f"""WITH {V.PIXELS}, tiles AS (SELECT (y0 // 64) * 4 + x0 // 64 AS tile_index, y0, x0 FROM range(0, 256, 64) a(y0), range(0, 256, 64) b(x0))
 SELECT CAST(tile_index AS BIGINT) AS tile_index, CAST(y0 AS INTEGER) AS y_core_start, CAST(y0 + 64 AS INTEGER) AS y_core_stop, CAST(greatest(y0 - 8, 0) AS INTEGER) AS y_start, CAST(least(y0 + 72, 256) AS INTEGER) AS y_stop,
 CAST(x0 AS INTEGER) AS x_core_start, CAST(x0 + 64 AS INTEGER) AS x_core_stop, CAST(greatest(x0 - 8, 0) AS INTEGER) AS x_start, CAST(least(x0 + 72, 256) AS INTEGER) AS x_stop FROM tiles""")
def tile_extents(spark, sf):
    return _halo_tiles(spark, margin=8)


@query(f"WITH {V.PIXELS} SELECT CAST((y // 64) * 4 + x // 64 AS BIGINT) AS tile_index, 0 AS \"row\", count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM (SELECT y, x, max(value) AS value FROM pixels GROUP BY y, x) GROUP BY 1")
def reduce_tiles(spark, sf):
    image = _flat_image(spark, sf)
    return VB.reduce_tiles(image, _halo_tiles(spark, margin=0), lambda a: {"n": int((a > 0).sum()), "total": float(a.sum())}, "n long, total double", ["y", "x"])


@query(f"""WITH RECURSIVE {V.PIXELS}, flat AS (SELECT y, x, max(value) AS v FROM pixels GROUP BY y, x),
 tiles AS (SELECT i * 4 + j AS tile, greatest(i * 64 - 8, 0) AS y0, least(i * 64 + 72, 256) AS y1, greatest(j * 64 - 8, 0) AS x0, least(j * 64 + 72, 256) AS x1 FROM range(4) a(i), range(4) b(j)),
 best AS (SELECT tile, y0, x0, y, x, v, row_number() OVER (PARTITION BY tile ORDER BY v DESC, y, x) AS r FROM tiles JOIN flat ON y >= y0 AND y < y1 AND x >= x0 AND x < x1),
 found AS (SELECT tile, CAST(y0 + greatest(y - y0 - 2, 0) AS DOUBLE) AS ys, CAST(x0 + greatest(x - x0 - 2, 0) AS DOUBLE) AS xs, CAST(v AS DOUBLE) AS score FROM best WHERE r = 1),
 pairs AS (SELECT a.tile AS n, b.tile AS m, greatest(5 - abs(a.ys - b.ys), 0) * greatest(5 - abs(a.xs - b.xs), 0) AS common FROM found a JOIN found b ON a.tile <> b.tile),
 edges AS (SELECT n, m FROM pairs WHERE common / (50 - common) >= 0.3), placed AS (SELECT tile AS node, 0 AS c, row_number() OVER (ORDER BY score DESC, tile) AS k FROM found),
 {_GREEDY}
 SELECT tile, 0::INTEGER AS "row", ys AS y_start, xs AS x_start, score, ys + 5 AS y_stop, xs + 5 AS x_stop, row_number() OVER (ORDER BY tile) AS id FROM found JOIN stay ON node = tile""")
def detect_bright(spark, sf):
    """The brightest pixel of each tile as a box of 5 x 5, after suppression."""
    image = _flat_image(spark, sf)

    def brightest(patch: np.ndarray) -> list[dict]:
        y, x = np.unravel_index(int(patch.argmax()), patch.shape)
        return [{"y_start": float(max(y - 2, 0)), "y_length": 5.0, "x_start": float(max(x - 2, 0)), "x_length": 5.0, "score": float(patch.max())}]

    found = VB.detect(image, _halo_tiles(spark, margin=8), brightest, ["y", "x"], most=10, score=True)
    return VB.suppress(found, ["y", "x"], 0.3, "score")


@query(f"""WITH {V.LABELS}, first AS (SELECT label, min((y // 40) * 7 + x // 40) AS unit FROM label_grid WHERE label > 0 GROUP BY label),
 num AS (SELECT label, row_number() OVER (ORDER BY unit, label) AS n FROM first)
 SELECT y, x, CAST(coalesce(n, 0) AS BIGINT) AS label FROM label_grid LEFT JOIN num USING (label)""")
def stitch_tiles(spark, sf):
    """Grid objects predicted tile by tile with a margin of 8, made one label image again."""
    tiles = TI.by_grid(spark.createDataFrame([(V.EDGE, V.EDGE)], "size_y int, size_x int"), {"y": 40, "x": 40})
    labels = V.label_grid(spark)
    near = lambda a, m: (F.col(a) >= F.col(f"tile_{a}.start") - m) & (F.col(a) < F.col(f"tile_{a}.start") + F.col(f"tile_{a}.length") + m)
    boxes = tiles.select("tile_index", "tile_y", "tile_x", *[x for a in ("y", "x") for x in ((F.col(f"tile_{a}.start") - 8).alias(f"{a}_start"), (F.col(f"tile_{a}.start") + F.col(f"tile_{a}.length") + 8).alias(f"{a}_stop"))])
    cell = lambda low, high: F.explode(F.sequence(F.floor(low / 16), F.floor(high / 16)))
    boxes = boxes.withColumn("cy", cell(F.col("y_start"), F.col("y_stop") - 1)).withColumn("cx", cell(F.col("x_start"), F.col("x_stop") - 1))
    marked = labels.withColumn("cy", F.floor(F.col("y") / 16)).withColumn("cx", F.floor(F.col("x") / 16))
    predicted = marked.join(boxes, ["cy", "cx"]).where(near("y", 8) & near("x", 8))
    predicted = predicted.select(F.col("tile_index").alias("tile"), "y", "x", "label", (near("y", 0) & near("x", 0)).alias("core"))
    return stitch(predicted, ["y", "x"], 1000)


@query(f"""WITH {V.BOXES}, b AS (SELECT * FROM boxes) SELECT id, CAST(x_start >= 100 AND x_stop <= 140 AS BOOLEAN) AS inside FROM b WHERE x_start < 140 AND x_stop > 100""")
def window_filter(spark, sf):
    """Regions that meet a window, and whether they lie in it."""
    window = R.span(F.lit(100.0), F.lit(40.0))
    r = V.event_regions(spark, sf).where(R.meets(F.col("x"), window))
    return r.select(F.col("label").alias("id"), ((F.col("x.start") >= 100) & (R.end_of(F.col("x")) <= 140)).alias("inside"))
