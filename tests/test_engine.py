"""Golden cases of the engine's operators on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

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


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def pairs_of(value):
    return [(r["start"], r["length"]) for r in value]


@pytest.mark.parametrize(
    ("dim", "tail", "wanted"),
    [
        (100, "clip", [(0, 32), (32, 32), (64, 32), (96, 4)]), (100, "balance", [(0, 32), (32, 32), (64, 18), (82, 18)]), (65, "balance", [(0, 32), (32, 17), (49, 16)]),
        (100, "shift", [(0, 32), (32, 32), (64, 32), (68, 32)]), (20, "shift", [(0, 20)]), (100, "drop", [(0, 32), (32, 32), (64, 32)]), (20, "balance", [(0, 20)]),
    ],
)
def test_axis_tiles(spark, dim, tail, wanted):
    assert pairs_of(one(spark, TI.axis_tiles(F.lit(dim), F.lit(32), tail=tail))) == wanted


def test_axis_errors_and_blocks(spark):
    assert pairs_of(one(spark, TI.axis_blocks(F.lit(100), 3))) == [(0, 34), (34, 33), (67, 33)]
    for bad in (TI.axis_tiles(F.lit(20), F.lit(32), tail="drop"), TI.axis_tiles(F.lit(0), F.lit(32)), TI.axis_blocks(F.lit(2), 3)):
        with pytest.raises(Exception):  # noqa: B017
            one(spark, bad)
    with pytest.raises(ValueError):
        TI.axis_tiles(F.lit(20), F.lit(8), F.lit(4), "balance")


def span(a, b):
    return R.span(F.lit(a), F.lit(b))


def test_region_algebra(spark):
    assert one(spark, R.meet(span(0, 1), span(0.5, 1))) == (0.5, 0.5)
    assert one(spark, R.meets(span(0, 1), span(1, 1))) is False
    assert one(spark, R.meet(R.no_span(), span(-1, 2))) == (-1.0, 2.0)
    assert one(spark, R.join(span(0, 1), span(0.5, 1))) == (0.0, 1.5)
    assert one(spark, R.high_of(span(-2, 2))) == math.inf  # an end of exactly 0 is open
    assert one(spark, R.meet(span(-2, 2), span(1, 4))) == (1.0, 4.0)
    assert one(spark, R.meet(R.span(F.lit(None), F.lit(None)), R.span(F.lit(3), F.lit(None)))) == (3.0, None)
    assert one(spark, R.to_slice(R.span(F.lit(None), F.lit(5)), F.lit(10))) == (0, 10)
    assert one(spark, R.to_slice(span(-1.5, 4.2), F.lit(10))) == (0, 3)
    assert one(spark, R.zoom(span(1, 4), 2.0)) == (0.0, 8.0)
    assert one(spark, R.to_pixel_value(F.lit(1.003), F.lit(0.5))) == 2.0 and one(spark, R.to_pixel_value(F.lit(1.1), F.lit(0.5))) == pytest.approx(2.2)
    assert one(spark, R.joined_name(F.lit("a"), F.lit("b"))) == "a:b" and one(spark, R.joined_name(F.lit(None), F.lit(""))) == ""
    assert one(spark, R.joined_label(F.lit(0), F.lit(None).cast("int"))) == 0
    with pytest.raises(Exception):  # noqa: B017
        one(spark, R.joined_label(F.lit(1), F.lit(2)))
    assert one(spark, R.chunk_rect(F.lit(5), F.lit(5), F.lit(4))) is None and one(spark, R.chunk_rect(F.lit(3), F.lit(9), F.lit(4))) == (0, 2)


def test_overlap_pairs_equal_theta_join(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(x + w), float(y), float(y + h)) for i, (x, y, w, h) in enumerate(zip(*rng.integers(1, 40, (4, 120)), strict=True))]
    boxes = spark.createDataFrame(rows, "id int, x_start double, x_stop double, y_start double, y_stop double")
    got = {(r.a.id, r.b.id) for r in S.overlap_pairs(boxes, "id", ["x", "y"], {"x": 7.0, "y": 5.0}).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] < b[2] and b[1] < a[2] and a[3] < b[4] and b[3] < a[4]}
    assert got == want and S.any_overlap(boxes, "id", ["x", "y"], {"x": 7.0, "y": 5.0})


def image(spark, array, value="value"):
    rows = [(*map(int, at), int(v)) for at, v in np.ndenumerate(np.asarray(array))]
    return spark.createDataFrame(rows, "y int, x int, " + value + " long")


def test_labels(spark):
    a, b = image(spark, [[1, 1], [0, 2]], "label"), image(spark, [[7, 7], [0, 9]], "label")
    assert {(r.a, r.b): r.iou for r in L.overlap_iou(a, b, ["y", "x"]).collect()} == {(1, 7): 1.0, (2, 9): 1.0}
    c, d = image(spark, [[1, 1], [1, 1]], "label"), image(spark, [[5, 5], [6, 6]], "label")
    assert {r.iou for r in L.overlap_iou(c, d, ["y", "x"]).collect()} == {0.5}
    mapping = spark.createDataFrame([(1, 100), (4, 400)], "old long, new long")
    grid = image(spark, [[0, 1, 2], [3, 4, 5]], "label")
    assert sorted(r.label for r in L.relabel(grid, mapping).collect()) == [0, 2, 3, 5, 100, 400]
    big = np.zeros((8, 8), int)
    big[0:2, 0:2], big[6:8, 6:8] = 9000, 5000
    unit = F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4)
    assert {r.old: r.new for r in L.relabel_sequential(image(spark, big, "label"), unit).collect()} == {9000: 1, 5000: 2}
    boxes = L.bounding_boxes(image(spark, big, "label"), ["y", "x"], {"y": 0.5, "x": 0.5}).where("label = 5000").first()
    assert (boxes.name, tuple(boxes.y), tuple(boxes.x)) == ("5000", (3.0, 1.0), (3.0, 1.0))
    with pytest.raises(Exception):  # noqa: B017
        image(spark, big, "label").select(L.checked_offset(F.col("label"), 100, F.lit(1))).collect()


def test_pyramid(spark):
    assert Y.level_shapes({"y": 65, "x": 3}, {"y": 2, "x": 2}, 4)[3] == {"y": 8, "x": 1}
    merged = Y.merge_regions([{"y": (0, 10), "x": (0, 10)}, {"y": (10, 20), "x": (10, 20)}])
    assert merged == [{"y": (0, 20), "x": (0, 20)}]
    assert Y.coverage([{"y": (0, 10), "x": (0, 10)}, {"y": (20, 30), "x": (0, 10)}], {"y": 100, "x": 100}) == pytest.approx(0.02)
    arr = np.arange(36).reshape(6, 6)
    img, sizes, f = image(spark, arr), {"y": 6, "x": 6}, {"y": 2, "x": 2}
    full = Y.coarsen(img, f, sizes, dtype="uint8")
    assert {(r.y, r.x): r.value for r in full.collect()} == {(y, x): int(arr[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean()) for y in range(3) for x in range(3)}
    changed = img.withColumn("value", F.when((F.col("y") < 1) & (F.col("x") < 3), 7).otherwise(F.col("value")))
    part = Y.refresh(changed, full, [{"y": (0, 1), "x": (0, 3)}], f, sizes, {"y": 1, "x": 1}, dtype="uint8")
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, Y.coarsen(changed, f, sizes, dtype="uint8").collect()))


def test_pixels(spark):
    img = image(spark, np.arange(12).reshape(3, 4))
    assert sorted(r.value for r in P.select(img, {"y": 3, "x": 4}, y=1, x=slice(0.5, 2.5)).collect()) == [4, 5, 6]
    with pytest.raises(IndexError):
        P.select(img, {"y": 3, "x": 4}, y=3)
    with pytest.raises(ValueError):
        P.select(img, {}, t=2)
    patch = image(spark, [[200, 0], [1, 100]])
    for rule, want in (("max", 200), ("sum", 200), ("min", 0), ("keep_nonzero", 200), ("overwrite", 200)):
        assert P.write(img, patch, ["y", "x"], rule, "uint8").where("y = 0 and x = 0").first().value == want
    assert P.write(image(spark, [[100]]), image(spark, [[200]]), ["y", "x"], "sum", "uint8").first().value == 44
    back = P.from_chunks(P.to_chunks(img, ["y", "x"], {"y": 2, "x": 3}), ["y", "x"], {"y": 2, "x": 3})
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, img.collect()))
    assert P.match_shape(img, {"y": 3, "x": 4}, {"y": 4, "x": 3}).count() == 12
    with pytest.raises(ValueError):
        P.match_shape(img, {"y": 3, "x": 4}, {"y": 3, "x": 9})


def test_percentiles_and_measure(spark):
    img = image(spark, [[0, 1, 2], [3, 4, 5]]).withColumn("c", F.lit(0)).unionByName(image(spark, [[0]]).withColumn("c", F.lit(1)))
    got = {r.c: (r.p0, r.p1) for r in ST.percentiles(img, [0, 50]).collect()}
    assert got == {0: (1.0, 3.0), 1: (0.0, 0.0)}
    m = ST.measure(image(spark, [[1, 2], [3, 4]]), image(spark, [[1, 1], [0, 2]], "label"), ["y", "x"]).collect()
    assert {r.label: (r.area, r["mean"]) for r in m} == {1: (2, 1.5), 2: (1, 4.0)}


@pytest.mark.parametrize("rounds", [0, 1, 8])
def test_suppression_equals_a_plain_greedy_choice(spark, monkeypatch, rounds):
    """By rounds, by components after them, and both; a chain is longer than the rounds. A null score comes last."""
    monkeypatch.setattr(VB, "ROUNDS", rounds)
    rng = np.random.default_rng(5)
    rows = [(int(i // 7), int(i % 7), float(x), float(x + w), float(y), float(y + 6), float(s), ["a", "b", None][i % 3]) for i, (x, w, y, s) in enumerate(zip(rng.integers(0, 60, 150), rng.integers(6, 9, 150), rng.integers(0, 30, 150), rng.integers(0, 40, 150), strict=True))]
    rows += [(100, i, 500.0 + 2 * i, 508.0 + 2 * i, 0.0, 6.0, 90.0 - i, "a") for i in range(30)]
    rows += [(200, 0, 900.0, 908.0, 0.0, 6.0, None, "a"), (200, 1, 901.0, 909.0, 0.0, 6.0, -5.0, "a")]
    boxes = spark.createDataFrame(rows, "tile long, row int, x_start double, x_stop double, y_start double, y_stop double, score double, t string")
    kept = []
    for r in sorted(rows, key=lambda r: (r[6] is None, -(r[6] or 0), r[0], r[1])):
        def like(k, r=r):
            both = max(0, min(r[3], k[3]) - max(r[2], k[2])) * max(0, min(r[5], k[5]) - max(r[4], k[4]))
            return r[7] == k[7] and both / ((r[3] - r[2]) * 6 + (k[3] - k[2]) * 6 - both) >= 0.5
        if not any(map(like, kept)):
            kept.append(r)
    got = VB.suppress(boxes, ["x", "y"], 0.5, group=["t"], cell={"x": 16.0, "y": 16.0}).orderBy("id").collect()
    assert [(r.tile, r.row) for r in got] == sorted(r[:2] for r in kept) and [r.id for r in got] == list(range(1, len(kept) + 1))


def test_suppression_by_rounds_needs_no_python_on_the_boxes(spark, monkeypatch):
    monkeypatch.setattr(VB, "connected_components", lambda *a: pytest.fail("short chains of overlaps are settled in rounds"))
    boxes = spark.createDataFrame([(0, i, 4.0 * i, 4.0 * i + 8, 0.0, 4.0, float(-i)) for i in range(9)], "tile long, row int, x_start double, x_stop double, y_start double, y_stop double, score double")
    assert [r.row for r in VB.suppress(boxes, ["x", "y"], 0.3).orderBy("id").collect()] == [0, 2, 4, 6, 8]


def broadcasts(df):
    df.collect()
    return "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_touching_pairs_come_from_one_join(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(x + w), float(y), float(y + h)) for i, (x, w, y, h) in enumerate(zip(*(rng.integers(lo, hi, 120) for lo, hi in ((0, 40), (1, 9), (0, 40), (1, 9))), strict=True))]
    boxes = spark.createDataFrame(rows, "id long, x_start double, x_stop double, y_start double, y_stop double")
    pairs = S.touching_only(boxes, "id", ["x", "y"], {"x": 7.0, "y": 5.0}, "x")
    meet = lambda a, b: a[0] < b[0] and (a[2] == b[1] or b[2] == a[1]) and a[3] < b[4] and b[3] < a[4]
    assert not broadcasts(pairs) and pairs._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") in (1, 2)  # the plan that ran, and the first one
    assert sorted(map(tuple, pairs.collect())) == sorted((a[0], b[0]) for a in rows for b in rows if meet(a, b)) != []


def test_components_broadcast_nothing(spark, monkeypatch):
    from mosaiq.plans import graph

    held = []
    write = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: held.append(broadcasts(df)) or write(df, name))
    edges = spark.range(50).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in connected_components(edges).collect()} == {0}
    assert len(held) > 5 and not any(held)


def test_suppression(spark):
    schema = "tile long, row int, x_start double, x_stop double, y_start double, y_stop double, score double, t int"
    boxes = spark.createDataFrame([(0, 0, 0.0, 10.0, 0.0, 10.0, 0.9, 0), (0, 1, 2.0, 12.0, 2.0, 12.0, 0.5, 0), (1, 0, 0.0, 10.0, 0.0, 10.0, 0.1, 1)], schema)
    assert [r.id for r in VB.suppress(boxes, ["x", "y"], 0.4, group=["t"]).orderBy("id").collect()] == [1, 2]
    assert VB.suppress(boxes, ["x", "y"], 0.6, group=["t"]).count() == 3
    assert VB.suppress(boxes.limit(0), ["x", "y"], 0.6).count() == 0


def test_detect_and_stitch(spark):
    arr = np.zeros((64, 64))
    arr[10:20, 26:38] = 255
    img = spark.createDataFrame([(*map(int, at), float(v)) for at, v in np.ndenumerate(arr) if v], "y int, x int, value double")
    tiles = TI.by_grid(spark.createDataFrame([(64, 64)], "size_y int, size_x int"), {"y": 32, "x": 32})
    for a in ("y", "x"):
        h = R.halo(F.col(f"tile_{a}.start"), F.col(f"tile_{a}.start") + F.col(f"tile_{a}.length"), 8, F.lit(64))
        tiles = tiles.withColumn(f"{a}_start", h["first"]).withColumn(f"{a}_stop", h["stop"])

    def bright(p):
        ys, xs = np.nonzero(p)
        return [] if not len(ys) else [{"y_start": float(ys.min()), "y_length": float(np.ptp(ys) + 1), "x_start": float(xs.min()), "x_length": float(np.ptp(xs) + 1)}]

    found = VB.suppress(VB.detect(img, tiles.drop("tile_y", "tile_x"), bright, ["y", "x"]), ["y", "x"], 0.5, None)
    assert [(r.x_start, r.x_stop, r.y_start, r.y_stop) for r in found.collect()] == [(26.0, 38.0, 10.0, 20.0)]
    rows = [(t, y, x, int(arr[y, x] > 0), x // 32 == t) for t in (0, 1) for y in range(64) for x in range(max(0, 32 * t - 4), min(64, 32 * t + 36))]
    joined = stitch(spark.createDataFrame(rows, "tile long, y int, x int, label long, core boolean"), ["y", "x"], 1000)
    assert {r.label for r in joined.where("y between 10 and 19 and x between 26 and 37").collect()} == {1} and joined.count() == 64 * 64


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1)] + [(i, i + 1) for i in range(100, 160)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | dict.fromkeys(range(100, 161), 100)
    assert connected_components(edges.limit(0)).count() == 0


def test_tables(spark):
    a, b = spark.createDataFrame([(1, 4, 1)], "x long, y long, label long"), spark.createDataFrame([(2, 1)], "x long, label long")
    rows = T.concat([(a, {"column1": "value1"}), (a, {"column1": "value2"})], "Index").collect()
    assert sorted(r.Index for r in rows) == ["value1_1", "value2_1"]
    with pytest.raises(T.TableError):
        T.concat([(a, {}), (b, {})])
    assert T.concat([(a, {}), (b, {})], lazy=False).where("y is null").count() == 1
    with pytest.raises(T.TableError):
        T.with_index(a, "nope", "int")
    with pytest.raises(T.TableError):
        T.to_regions(a)
    catalog = spark.createDataFrame([(1, "t1", "roi_table"), (2, "t1", "roi_table"), (2, "t2", "feature_table")], "image int, name string, kind string")
    assert [r.name for r in T.list_names(catalog).collect()] == ["t1"]
    assert sorted(r.name for r in T.list_names(catalog, "all").collect()) == ["t1", "t2"]
    assert T.storage_order(spark.createDataFrame([(1, 1.5, "a", True)], "i long, d double, s string, b boolean")) == ["d", "b", "i", "s"]


def test_plate(spark):
    p = PL.add_image(PL.add_image(PL.empty_plate(spark), "p", "A", 1, "0"), "p", "B", "02", "0", 1)
    with pytest.raises(ValueError):
        PL.add_image(p, "p", "A", "01", "0")
    assert [r.path for r in PL.images(p, column="2").collect()] == ["B/02/0"]
    assert PL.remove_image(p, "p", "A", "1", "0").count() == 1
    with pytest.raises(KeyError):
        PL.remove_image(p, "p", "C", 1, "0")
