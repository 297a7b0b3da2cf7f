"""Sources, scheduling, streaming, the container handle, and the queries against their SQL."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from mosaiq import container as C
from mosaiq.operators import tables as T
from mosaiq.operators.pyramid import coarsen
from mosaiq.plans import schedule as SC
from mosaiq.sources import tables_io as IO
from mosaiq.sources import zarr as Z
from mosaiq.streaming import live


@pytest.mark.parametrize("backend", ["parquet", "csv", "json", "arrays", "anndata_v1"])
def test_table_formats(spark, tmp_path, backend):
    table = spark.createDataFrame([(1, 4.1, "a"), (2, 5.1, "b"), (3, 6.1, "c")], "label long, b double, c string")
    IO.write_table(table, str(tmp_path / "t"), T.KINDS["feature_table"], backend)
    got, meta = IO.read_table(spark, str(tmp_path / "t"))
    assert meta.kind == "feature_table" and dict(got.dtypes)["label"] == "bigint"
    assert sorted((r.label, r.b, r.c) for r in got.collect()) == [(1, 4.1, "a"), (2, 5.1, "b"), (3, 6.1, "c")]
    with pytest.raises(ValueError):
        IO.format_of("nope")


@pytest.mark.parametrize("codec", [None, "zlib"])
def test_chunked_array_source(spark, tmp_path, codec):
    array = np.arange(2 * 7 * 9, dtype="<u2").reshape(2, 7, 9)
    Z.write_array(str(tmp_path / "a"), array, [1, 4, 4], codec)
    Z.register(spark)
    got = spark.read.format("chunked_array").option("y", "2:6").option("x", "3:9").load(str(tmp_path / "a"))
    assert {(r.z, r.y, r.x): r.value for r in got.collect()} == {(z, y, x): int(array[z, y, x]) for z in range(2) for y in range(2, 6) for x in range(3, 9)}
    reader = Z.ArrayReader({"path": str(tmp_path / "a"), "y": "5:6", "z": "0:1"})
    assert [p.at for p in reader.partitions()] == [[(0, 1, 0), (0, 1, 1), (0, 1, 2)]]  # only chunks that the selection touches
    os.remove(tmp_path / "a" / "0.0.0")
    assert spark.read.format("chunked_array").load(str(tmp_path / "a")).count() == array.size - 16


def test_schedule(spark):
    prints = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "c"), (4, "d"), (4, "d")], "unit int, chunk string")
    assert sorted(map(tuple, SC.conflict_edges(prints).collect())) == [(0, 1), (1, 2)]
    comps = SC.conflict_components(prints)
    assert {r.unit: r.component for r in comps.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    dealt = {r.unit: r.job for r in SC.jobs(comps, 2).collect()}
    assert dealt[0] == dealt[1] == dealt[2] == 0 and dealt[3] == dealt[4] == 1
    assert SC.waves([0, 1, 2, 3], [(0, 1), (1, 2)]) == {0: 0, 1: 1, 2: 0, 3: 0}
    assert SC.fingerprint(prints, ["unit", "chunk"], 2) == SC.fingerprint(prints.repartition(3), ["unit", "chunk"], 2) != SC.fingerprint(prints, ["unit", "chunk"], 3)
    parts = spark.createDataFrame([(1, 5, 0, "x"), (0, 2, 1, "z"), (0, 2, 0, "y")], "job int, index int, row int, v string")
    assert [r.v for r in SC.merged_partials(parts, 2).orderBy("place").collect()] == ["y", "z", "x"]
    with pytest.raises(ValueError):
        SC.merged_partials(parts, 3)


def test_streaming_windows(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:04:59", "a", 3.0), ("2024-01-01 00:05:00", "a", 5.0), ("2024-01-01 01:00:00", "b", 1.0)]
    spark.createDataFrame(rows, "at string, k string, v double").select(F.to_timestamp("at").alias("at"), "k", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, k string, v double").parquet(str(tmp_path / "in"))
    q = live.windowed_measure(stream, "at", "5 minutes", "v", ["k"]).writeStream.format("memory").queryName("win").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.n, r.total) for r in spark.table("win").collect()) == [("a", 1, 5.0), ("a", 2, 4.0), ("b", 1, 1.0)]


def test_streaming_refresh(spark, tmp_path):
    now = spark.createDataFrame([(y, x, 10 * y + x) for y in range(8) for x in range(8)], "y int, x int, value long")
    now.where("y = 3 and x in (4, 5)").write.parquet(str(tmp_path / "writes"))
    made = []
    f = live.refresh_batch(lambda: now, lambda df: made.append(sorted(map(tuple, df.collect()))), {"y": 2, "x": 2}, {"y": 8, "x": 8})
    q = spark.readStream.schema("y int, x int, value long").parquet(str(tmp_path / "writes")).writeStream.foreachBatch(f).start()
    q.processAllAvailable()
    q.stop()
    want = coarsen(now, {"y": 2, "x": 2}, {"y": 8, "x": 8}).where("y = 1 and x = 2")
    assert made == [sorted(map(tuple, want.collect()))]


def test_container(spark, tmp_path):
    rng = np.random.default_rng(0)
    pixels = rng.integers(1, 200, (2, 16, 16))
    labels = np.zeros((16, 16), int)
    labels[2:6, 2:6], labels[10:14, 10:14] = 1, 2
    box = C.create(spark, pixels, {"y": 0.5, "x": 0.5}, "cyx")
    rows = spark.createDataFrame([(*map(int, at), int(v)) for at, v in np.ndenumerate(labels)], "y int, x int, label long")
    box = box.with_label("nuclei", rows).consolidate({"y": 2, "x": 2}, 3)
    assert [i.shape for i in box.levels] == [{"c": 2, "y": 16, "x": 16}, {"c": 2, "y": 8, "x": 8}, {"c": 2, "y": 4, "x": 4}]
    assert box.image(pixel={"y": 1.1, "x": 1.1}).shape["y"] == 8
    means = {(r.label, r.c): r["mean"] for r in box.measure("nuclei").collect()}
    assert means[1, 0] == pytest.approx(pixels[0, 2:6, 2:6].mean()) and len(means) == 4
    regions = box.masking_regions("nuclei")
    box = box.with_table("rois", regions, "masking_roi_table")
    box.save(str(tmp_path / "c"))
    back = C.open_container(spark, str(tmp_path / "c"))
    assert back.list_tables(["masking_roi_table"]) == ["rois"] and back.levels[2].pixel["x"] == 2.0
    cut = back.image().get_regions(back.tables["rois"][0].where("label = 2").select("label", "y", "x"))
    assert sorted(r.value for r in cut.where("c = 1").collect()) == sorted(pixels[1, 10:14, 10:14].ravel().tolist())
    patched = back.image().set(spark.createDataFrame([(0, 0, 0, 999)], "c int, y int, x int, value long"), "max")
    assert patched.get(c=0, y=0, x=0).first().value == 999 and patched.rows.count() == pixels.size
    assert C.synthetic(spark, {"y": 5, "x": 6}, {}).image().rows.distinct().count() == 30
    assert back.derive().image().rows.count() == 0 and back.image().whole().count() == 1 and back.image().tiles("blocks", many={"x": 4}).count() == 4
    with pytest.raises(KeyError):
        back.without_label("nope")


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """A folder of small tables with ids on both sides of the bounds of the queries with SQL."""
    rng = np.random.default_rng(6)
    path = str(tmp_path_factory.mktemp("whole"))
    events = [(int(i), ["view", "buy"][i % 5 == 0], int(rng.integers(0, 60))) for i in [*range(280, 340), *range(1980, 2040)]]
    spark.createDataFrame(events, "event_id long, event_type string, user_id long").write.parquet(f"{path}/events.parquet")
    lines = [tuple(map(int, r)) for r in rng.integers([1, 0, 0, 1], [8, 256, 256, 51], (8000, 4))]
    spark.createDataFrame(lines, "l_linenumber long, l_orderkey long, l_partkey long, l_quantity long").write.parquet(f"{path}/lineitem.parquet")
    spark.range(1, 200).select(F.col("id").alias("c_custkey")).write.parquet(f"{path}/customer.parquet")
    return path, events, lines


def test_pixels_of_every_region(spark, whole):
    path, events, lines = whole
    pixels = {}
    for n, o, p, q in lines:
        at = (n % 3, o % 256, p % 256)
        pixels[at] = max(q, pixels.get(at, 0))
    want = {(i, c, y, x, v) for i, _, u in events for (c, y, x), v in pixels.items() if u <= x < u + 1 + i % 17 and i % 200 <= y < i % 200 + 1 + i % 13}
    got = [tuple(r) for r in __spark_entry__.queries()["region_pixels"](spark, path).collect()]
    assert set(got) == want and len(got) == len(want) and max(r[0] for r in got) >= 300


def test_unique_names_of_all_events(spark, whole):
    path, events, _ = whole
    seen, want = {}, {}
    for i, kind, _ in sorted(events):
        seen[kind] = seen.get(kind, 0) + 1
        want[i] = kind if seen[kind] == 1 else f"{kind}_{seen[kind]}"
    got = [tuple(r) for r in __spark_entry__.queries()["unique_roi_names"](spark, path).collect()]
    assert dict(got) == want and len(got) == len(want)
    odd = spark.range(40).select(F.col("id").alias("row"), F.when(F.col("id") % 3 > 0, "a").alias("name")).repartition(3)
    named = T.unique_names(odd, "name", "row")
    assert named.columns == ["row", "name"] and [r.name for r in named.orderBy("row").collect()][:5] == [None, "a", "a_2", None, "a_3"]
    assert T.unique_names(odd.limit(0), "name", "row").count() == 0


def test_all_pairs_links_and_pixels(spark, whole):
    path, events, _ = whole
    run = lambda name: [tuple(r) for r in __spark_entry__.queries()[name](spark, path).collect()]
    boxes = [(i, u, u + 1 + i % 17, i % 200, i % 200 + 1 + i % 13) for i, _, u in events]
    over = lambda a, b, more=0: a[1] < b[2] + more and b[1] < a[2] + more and a[3] < b[4] and b[3] < a[4]
    both = [(a, b) for a in boxes for b in boxes if a[0] < b[0]]
    want = sorted((a[0], b[0], max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), min(a[4], b[4])) for a, b in both if over(a, b))
    assert sorted(run("overlap_pairs")) == want and any(r[0] % 10 != r[1] % 10 for r in want)
    want = sorted((a[0], b[0]) for a, b in both if over(a, b, 1) and not over(a, b))
    assert sorted(run("touching_pairs")) == want and any(a % 10 != b % 10 for a, b in want)
    label = {k: k for c in range(1, 200) for k in (c, c + 1 + c % 7)}
    for _ in range(200):
        for c in range(1, 200):
            label[c] = label[c + 1 + c % 7] = min(label[c], label[c + 1 + c % 7])
    got = run("components_min_label")
    assert dict(got) == label and len(got) == len(label)
    pixels = {(y, x): v for y, x, v in run("stitch_tiles")}
    objects = {}
    for (y, x), v in pixels.items():
        if (x + y) % 5 == 0:
            assert v == 0
        else:
            objects.setdefault((y // 16, x // 16), set()).add(v)
    assert len(pixels) == 256 * 256 and all(len(v) == 1 for v in objects.values()) and set.union(*objects.values()) == set(range(1, 257))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_queries_equal_their_sql(spark):
    import duckdb

    from mosaiq.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    norm = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    wrong = []
    for name in ("feature_measure", "roi_product_grid", "overlap_pairs", "relabel_canonical", "pyramid_refresh", "channel_percentiles", "merge_sum", "grid_tiles_balance", "components_min_label"):
        df = QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        got = sorted((norm(r) for r in df.select(*cols).collect()), key=repr)
        found = con.execute(ORACLE_SQL[name])
        at = [[c[0] for c in found.description].index(c) for c in cols]
        want = sorted((norm([r[i] for i in at]) for r in found.fetchall()), key=repr)
        if got != want:
            wrong.append(name)
    assert not wrong


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_numbers_along_an_order(spark):
    from mosaiq.plans.numbering import numbered

    keys = [(i * 37) % 101 for i in range(400)] + [None, None]
    rows = spark.createDataFrame([(k, i, -i) for i, k in enumerate(keys)], "k int, i int, n int").repartition(7)
    want = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0, i))
    got = numbered(rows, ["k", "i"], "n", first=0)
    assert got.columns == ["k", "i", "n"] and dict(got.dtypes)["n"] == "bigint"
    assert [r.i for r in got.orderBy("n").collect()] == want and sorted(r.n for r in got.collect()) == list(range(len(keys)))
    assert sorted(r.n for r in numbered(rows, ["k"], "n").collect()) == list(range(1, len(keys) + 1))  # ties
    assert numbered(rows.limit(0), ["k"], "n").count() == 0
