"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are normalised and rotated to their principal axes, so that the first coordinates carry most
of a product. They are grouped into tiles of bounded size that are close in these coordinates, which
lie as arrays in the shared folder. Neighbouring tiles form blocks, and a task reads two blocks and
compares their tiles, unless the boxes of blocks or tiles are too far apart. So vectors are read about
as often as the root of the number of tasks, and none crosses a shuffle to be compared. Within a pair of tiles, products of the
leading coordinates are taken first; a pair of vectors whose leading product plus the product of the
norms of what is left cannot reach the threshold is given up, the others accumulate further blocks
of coordinates. Those that remain are decided by the cosine of the given vectors in double precision.

Equal vectors are compared once and counted by their number. A pair of tiles reports for each vector
how many others it links to, and one link to its root within the two tiles, never all pairs; the
roots are joined by connected components. No task holds more than the tiles of two blocks.

Defined cases: a vector that is null, empty or zero, or has null or non-finite components, links with
nothing, and so does a row without an id (its component is null, it is not kept). Vectors of unequal
length do not link. Rows with equal ids are one node, each row counted. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import table
from mosaiq.llm.store import Store
from mosaiq.plans.graph import connected_components
from mosaiq.plans.scratch import fresh_path, materialise

THRESHOLD, TILE, STRIP = 0.95, 4096, 512
#: The rotation is fitted to at most this many rows and numbers; it decides the order of work only, never a result.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 4_000_000
#: Coordinates of the first product and of the boxes; the next blocks double.
LEAD = 16
#: Bytes that the tiles of two blocks may take in a task.
BLOCK_BYTES = 256 << 20
#: Slack for rounding in the bounds.
EPS = 1e-9


def usable(vector: str = "v") -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def rotation(sample: np.ndarray) -> np.ndarray:
    """Principal axes of the normalised rows, the strongest first."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    values, axes = np.linalg.eigh(unit.T @ unit)
    return axes[:, np.argsort(-values)]


def leaves(points: np.ndarray, levels: int) -> list[tuple[int, float]]:
    """A complete tree of (axis, median) splits by the widest of the leading axes, as an array."""
    tree: list[tuple[int, float]] = []
    groups = [points]
    for _ in range(levels):
        deeper = []
        for g in groups:
            axis = int(np.argmax(g.std(0))) if len(g) else 0
            cut = float(np.median(g[:, axis])) if len(g) else 0.0
            tree.append((axis, cut))
            deeper += [g[g[:, axis] <= cut], g[g[:, axis] > cut]]
        groups = deeper
    return tree


def leaf_of(points: np.ndarray, tree: list[tuple[int, float]], levels: int) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    axes, cuts = np.asarray([a for a, _ in tree], np.int64), np.asarray([c for _, c in tree])
    for _ in range(levels):
        node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] > cuts[node])
    return node - (2**levels - 1)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows padded with zeros to ``width``, lengths)."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out, sizes


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of 0..n-1's component under links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return label


def stops_of(width: int) -> list[int]:
    """Where the blocks of coordinates end."""
    stops = [min(LEAD, width)]
    while stops[-1] < width:
        stops.append(min(2 * stops[-1], width))
    return stops


def left_over(m: np.ndarray, k: int) -> np.ndarray:
    """Norms of unit rows without their first k coordinates."""
    return np.sqrt(np.maximum(1 - (m[:, :k] ** 2).sum(1), 0))


def prepared(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(rows, norms, rows normalised and rotated, what is left of their norms after each block of coordinates)."""
    norm = np.linalg.norm(x, axis=1)
    a = (x / norm[:, None]) @ axes
    return x, norm, a, [left_over(a, k) for k in stops_of(a.shape[1])]


def compare(one: tuple, other: tuple, sizes_x: np.ndarray, sizes_y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Strips of links (i, j) between the rows of two prepared tiles; i < j where they are the same tile."""
    (x, norm_x, a, rest_a), (y, norm_y, b, rest_b) = one, other
    stops = stops_of(a.shape[1])
    # the norm of what is left as one more coordinate: the bound is then a single product
    lead_b = np.column_stack([b[:, : stops[0]], rest_b[0]]).T
    for top in range(0, len(a), STRIP):
        own = slice(top, min(top + STRIP, len(a)))
        bound = np.column_stack([a[own, : stops[0]], rest_a[0][own]]) @ lead_b
        if same:
            bound[np.arange(own.stop - top)[:, None] + top >= np.arange(len(b))[None, :]] = -1
        i, j = np.nonzero(bound >= threshold - EPS)
        if len(i) * 8 > bound.size:  # most pairs remain: a dense product is cheaper than gathering
            cosine = (x[own] @ y.T) / np.outer(norm_x[own], norm_y)
            keep = cosine[i, j] >= threshold
            i, j = i[keep] + top, j[keep]
        else:
            i = i + top
            parts = []
            for c in range(0, len(i), 100_000):
                p, q = i[c : c + 100_000], j[c : c + 100_000]
                product = np.einsum("nk,nk->n", a[p, : stops[0]], b[q, : stops[0]])
                for s, k in enumerate(stops[1:], 1):
                    product = product + np.einsum("nk,nk->n", a[p, stops[s - 1] : k], b[q, stops[s - 1] : k])
                    live = product + rest_a[s][p] * rest_b[s][q] >= threshold - EPS
                    p, q, product = p[live], q[live], product[live]
                live = np.einsum("nk,nk->n", x[p], y[q]) / (norm_x[p] * norm_y[q]) >= threshold
                parts.append((p[live], q[live]))
            i, j = (np.concatenate([t[s] for t in parts]) if parts else np.zeros(0, np.int64) for s in (0, 1))
        equal = sizes_x[i] == sizes_y[j]
        yield i[equal], j[equal]


def links(classes: DataFrame, threshold: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """From (node, many, v) of distinct vectors: (node, n_links) and (a, b), enough links for the components."""
    spark = classes.sparkSession
    total, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not total:
        return spark.createDataFrame([], "node long, n_links long"), spark.createDataFrame([], "a long, b long")
    most = max(100, min(SAMPLE_ROWS, SAMPLE_NUMBERS // width))
    picked = classes.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(most).select("v")
    sample, _ = _matrix(pa.array([r["v"] for r in picked.collect()], pa.list_(pa.float64())), width)
    axes = rotation(sample)
    lead = min(LEAD, width)
    turned = (sample / np.linalg.norm(sample, axis=1, keepdims=True)) @ axes[:, :lead]
    levels = max(0, int(np.ceil(np.log2(max(total / (0.75 * tile), 1)))))
    tree = leaves(turned, levels)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                m, _ = _matrix(batch.column("v"), width)
                at = leaf_of((m / np.linalg.norm(m, axis=1, keepdims=True)) @ axes[:, :lead], tree, levels)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "leaf"])

    placed = materialise(classes.select("node", "many", "v").mapInArrow(place, "node long, many long, v array<double>, leaf long"), "tiles-rows")
    # a leaf with more rows than a tile holds is dealt to several tiles
    per_leaf = placed.groupBy("leaf").agg(F.count("*").alias("rows"))
    dealt = placed.join(per_leaf, "leaf").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / tile)).cast("long"))

    uri = fresh_path(spark, "tiles")

    def bundle(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        m, sizes = _matrix(group["v"].chunk(0), width)
        point = (m / np.linalg.norm(m, axis=1, keepdims=True)) @ axes[:, :lead]
        point = np.column_stack([point, left_over(point, lead)])  # distances are never less than with the norm of what is left as one more coordinate
        name, kept = f"{group['leaf'][0]}-{group['part'][0]}", _narrow(m)
        for what, values in (("rows", kept), ("nodes", group["node"].to_numpy()), ("many", group["many"].to_numpy()), ("sizes", sizes.astype(np.int64))):
            Store(uri).write(f"{what}-{name}", values)
        return pa.table({
            "leaf": group["leaf"].slice(0, 1), "part": group["part"].slice(0, 1), "rows": pa.array([len(m)], pa.int64()), "wide": pa.array([kept.dtype == np.float64]),
            "low": pa.array([point.min(0).tolist()]), "high": pa.array([point.max(0).tolist()]),
        })

    written = dealt.groupBy("leaf", "part").applyInArrow(bundle, "leaf long, part long, rows long, wide boolean, low array<double>, high array<double>")
    tiles = sorted(tuple(r) for r in written.collect())  # one row for each tile
    meta = np.asarray([t[:4] for t in tiles], np.int64)
    corners = np.asarray([t[4:] for t in tiles])
    Store(uri).write("meta", meta)
    Store(uri).write("corners", corners)
    count, partitions = len(tiles), int(spark.conf.get("spark.sql.shuffle.partitions"))
    # blocks small enough for several pairs of them a task slot, and for a task's memory
    side = max(1, min(BLOCK_BYTES // (4 * 8 * tile * width), math.ceil(count / math.sqrt(8 * partitions))))
    n_blocks = -(-count // side)
    n_pairs = n_blocks * (n_blocks + 1) // 2

    def meet(batches):
        store = Store(uri)
        meta = store.array("meta", np.int64, count * 4).reshape(count, 4)
        corners = store.array("corners", np.float64, count * 2 * (lead + 1)).reshape(count, 2, lead + 1)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                later = (math.isqrt(8 * number + 1) - 1) // 2
                blocks = [range(k * side, min((k + 1) * side, count)) for k in (number - later * (later + 1) // 2, later)]
                low, high = ([f(corners[b.start : b.stop, c], 0) for b in blocks] for c, f in enumerate((np.min, np.max)))
                if not _near(low[0], high[0], low[1:], high[1:], threshold)[0]:
                    continue
                opened: dict[int, tuple] = {}

                def tile_of(t):
                    if t not in opened:
                        x, *others = _open(store, meta[t], width)
                        opened[t] = prepared(x, axes), *others
                    return opened[t]

                for p in blocks[0]:
                    others = np.arange(max(p, blocks[1].start), blocks[1].stop)
                    for q in others[_near(*corners[p], corners[others, 0], corners[others, 1], threshold)].tolist():
                        (x, n_x, m_x, s_x), (y, n_y, m_y, s_y) = tile_of(p), tile_of(q)
                        same, nodes = p == q, n_x if p == q else np.concatenate([n_x, n_y])
                        found, root, shift = np.zeros(len(nodes), np.int64), np.arange(len(nodes)), 0 if same else len(n_x)
                        for i, j in compare(x, y, s_x, s_y, threshold, same):
                            if len(i):
                                found += np.bincount(i, m_y[j], len(found)).astype(np.int64) + np.bincount(j + shift, m_x[i], len(found)).astype(np.int64)
                                every = np.arange(len(found))
                                root = _roots(np.concatenate([every, i]), np.concatenate([root, j + shift]), len(found))
                        hit = np.flatnonzero(found)
                        yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(found[hit]), pa.array(nodes[root[hit]])], names=["node", "n_links", "root"])

    met = spark.range(0, n_pairs, 1, min(n_pairs, 32 * partitions)).mapInArrow(meet, "node long, n_links long, root long")
    met = materialise(met, "tiles-links")
    return met.groupBy("node").agg(F.sum("n_links").alias("n_links")), met.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()


def _near(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray, threshold: float) -> np.ndarray:
    """Whether vectors within the box can reach the threshold with vectors within each of the other boxes."""
    apart = np.maximum(np.maximum(np.asarray(lows) - high, low - np.asarray(highs)), 0)
    return (apart**2).sum(1) <= 2 - 2 * threshold + EPS


def _narrow(m: np.ndarray) -> np.ndarray:
    """Single precision where that holds the very same numbers."""
    single = m.astype(np.float32)
    return single if (single == m).all() else m


def _open(store: Store, meta: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, nodes, how many rows each stands for, lengths) of a tile."""
    leaf, part, n, wide = meta.tolist()
    rows = store.array(f"rows-{leaf}-{part}", np.float64 if wide else np.float32, n * width).reshape(n, width)
    return rows.astype(np.float64), *(np.asarray(store.array(f"{what}-{leaf}-{part}", np.int64, n)) for what in ("nodes", "many", "sizes"))


def dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", F.coalesce(usable(), F.lit(False)) & F.col("id").isNotNull())
    rows = materialise(rows.withColumn("h", F.when(F.col("ok"), F.struct(F.xxhash64("v").alias("x"), F.hash("v").alias("y")))), "vectors")
    classes = rows.where("ok").groupBy("h").agg(F.min("id").alias("node"), F.count("*").alias("many"), F.first("v").alias("v"))
    classes = materialise(classes, "vector-classes")
    counts, edges = links(classes.select("node", "many", "v"), threshold, tile)
    components = connected_components(edges)
    known = classes.select("h", "node", "many").join(counts, "node", "left").join(components, "node", "left")
    known = known.select("h", (F.coalesce("n_links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    return (
        rows.select("id", "h").join(known, "h", "left")
        .select(
            F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings"))


#: All pairs by plain cosine, components by handing on the ids that can be reached; for small tables, as it is quadratic.
OP7_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
 WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= {THRESHOLD} END),
 reach(node, seen) AS (SELECT a, a FROM links UNION SELECT l.b, r.seen FROM reach r JOIN links l ON l.a = r.node WHERE r.seen < l.b),
 low AS (SELECT node, min(seen) AS low FROM reach GROUP BY node), many AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
 SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(vec_id = coalesce(low, vec_id), false) AS kept
 FROM embeddings LEFT JOIN low ON low.node = vec_id LEFT JOIN many ON many.node = vec_id"""
