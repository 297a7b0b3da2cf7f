"""Near-duplicate documents by BagMinHash over word shingles.

A document is the multiset of its runs of SHINGLE words (lower-cased; a shorter text is one run).
Each (shingle, unit of weight) owns a Poisson process on a time axis. The units are discretised by
whole numbers and grouped into levels 0, 1, 2-3, 4-7, ...; one process of the level's total rate
stands for all of its units, and a point's unit is drawn with it, so a shingle of weight w takes the
points of units below w out of log2(w) + 1 processes. Every point falls into one of SLOTS slots, and
a slot keeps its earliest point. Processes are followed only up to the time by which all slots are
filled, so a signature needs about SLOTS * (ln SLOTS + 3) points however long the text. Two documents
agree in a slot with the probability of their weighted Jaccard similarity, without bias.

Equal documents (same words in order) are one class. Classes that agree in a band of ROWS slots are
candidates: with 24 bands of 4 a pair at similarity 0.8 is missed with probability 3e-6. Candidates
are verified by the exact multiset overlap and joined by connected components, in three rounds that
spare pairs which are already connected: the best link of each class to the leader of a shared
bucket, the remaining links to leaders, and then, within buckets whose members still lie in different
components, the members outside the bucket's largest component against all. The last round works in
cells of bounded size that count overlaps by an index and report one link per join, so no pairs of a
group are ever written, however many copies it has, and no link between two groups is lost.

Shingles are told apart by 52-bit hashes within a text and by 32-bit hashes when two texts are
compared, which changes a similarity by about n / 2**32. Defined cases: null texts are empty; texts
without words are equal to each other; rows with equal ids are rows of their own; of a class the row
with the smallest id stays (null ids last, then the first row); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import give_back, own_names, plain_names, table
from mosaiq.llm.language_model import tokens
from mosaiq.plans.graph import connected_components
from mosaiq.plans.scratch import materialise, rounds
from mosaiq.plans.ship import ship

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS
#: Rows signed at a time.
PART = 500
#: Ids are broadcast up to this many, and joined by shuffle beyond.
BROADCAST_IDS = 200_000
#: A cell of a bucket holds about so many members outside its largest component, and of all; a task takes about so many cells at a time.
MINORS, OTHERS, CELLS = 256, 512, 64

U64 = np.uint64
_G = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _times(step: int, factor: np.uint64) -> np.uint64:
    return U64(step * int(factor) & (1 << 64) - 1)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def shingles(counts: np.ndarray, index: np.ndarray, hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, 52-bit hash, times) of the distinct shingles of each text, ordered by text and hash; at most 4096 texts."""
    word = scramble(hashes)[index] if len(index) else np.zeros(0, U64)
    starts = np.cumsum(counts) - counts
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), n)
    first = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(counts, size)[doc]
    h = length.astype(U64)
    for k in range(size):
        inside = k < length
        at = np.minimum(first + k, max(len(word) - 1, 0))
        h = scramble(h * _G[k % len(_G)] + np.where(inside, word[at] if len(word) else U64(0), U64(0)) + U64(k))
    key = np.sort((doc.astype(U64) << U64(52)) | (h >> U64(12)))
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(begin, len(key)))
    key = key[begin]
    return (key >> U64(52)).astype(np.int64), key & U64((1 << 52) - 1), times


def signatures(doc: np.ndarray, shingle: np.ndarray, times: np.ndarray, many: int, slots: int = SLOTS) -> np.ndarray:
    """32-bit BagMinHash signatures [many, slots] of weighted multisets; all zero for an empty one."""
    earliest = np.full(many * slots, np.inf)
    weight = np.bincount(doc, times, many)
    todo = weight > 0
    room = 3.0
    while todo.any():
        horizon = np.where(todo, slots * (np.log(slots) + room) / np.maximum(weight, 1), 0.0)
        top = int(times[todo[doc]].max()).bit_length()
        for level in range(top + 1):
            low = 0 if level == 0 else 1 << (level - 1)
            rate = max(low, 1)
            live = np.flatnonzero(todo[doc] & (times > low))
            if not len(live):
                continue
            owner, limit, most = doc[live], horizon[doc[live]], times[live]
            seed = scramble(shingle[live] * _G[0] + _times(level + 1, _G[1]))
            time, step = np.zeros(len(live)), 0
            while len(owner):
                step += 1
                r = scramble(seed + _times(step, _G[2]))
                time = time - np.log(((r >> U64(12)).astype(np.float64) + 0.5) / 2.0**52) / rate
                near = time <= limit
                owner, limit, most, seed, time, r = (a[near] for a in (owner, limit, most, seed, time, r))
                r = scramble(r + _G[3])
                slot = ((r >> U64(32)) * U64(slots)) >> U64(32)
                unit = low + ((r & U64(0xFFFFFFFF)) * U64(rate) >> U64(32)).astype(np.int64)
                taken = unit < most
                np.minimum.at(earliest, owner[taken] * slots + slot[taken].astype(np.int64), time[taken])
        full = np.isfinite(earliest.reshape(many, slots)).all(1)
        todo &= ~full
        earliest.reshape(many, slots)[todo] = np.inf
        room += 6.0
    out = (scramble(earliest.view(U64)) >> U64(32)).astype(np.uint32).reshape(many, slots)
    out[weight == 0] = 0
    return out


def text_keys(counts: np.ndarray, index: np.ndarray, hashes: np.ndarray) -> list[bytes]:
    """16 bytes for each text's sequence of words."""
    if not len(index):
        return [bytes(16)] * len(counts)
    place = np.arange(len(index), dtype=U64) - np.repeat(np.cumsum(counts) - counts, counts).astype(U64)
    word, ends = hashes[index], np.concatenate([[0], np.cumsum(counts)])
    sums = []
    for g, h in ((_G[4], _G[5]), (_G[6], _G[2])):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(scramble(word * g + place * h + h), dtype=U64)])
        sums.append(total[ends[1:]] - total[ends[:-1]])
    pair = np.stack([*sums], axis=1)
    return [row.tobytes() if c else bytes(16) for row, c in zip(pair, counts, strict=True)]


def sign(documents: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with key, bands (array of long), shingles (sorted 32-bit numbers, repeats told apart)."""
    ship(documents.sparkSession)
    asked = documents.select(*keep, F.col(text_col).alias("__text"))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, PART):
                part = batch.slice(a, PART)
                counts, index, hashes = tokens(part.column(len(keep)))
                doc, shingle, times = shingles(counts, index, hashes)
                sig = signatures(doc, shingle, times, len(counts))
                bands = np.zeros((len(counts), BANDS), U64)
                for r in range(ROWS):
                    bands = scramble(bands * _G[r] + sig.reshape(len(counts), BANDS, ROWS)[:, :, r].astype(U64) + np.arange(BANDS, dtype=U64) + U64(1))
                wide = np.repeat(np.arange(len(doc)), times)
                again = np.arange(len(wide)) - np.repeat(np.cumsum(times) - times, times)
                small = scramble(shingle[wide] + again.astype(U64) * _G[1]) >> U64(32)
                small = (np.sort((doc[wide].astype(U64) << U64(32)) | small) & U64(0xFFFFFFFF)).astype("<u4")
                sizes = np.bincount(doc, times, len(counts)).astype(np.int64)
                ends = np.cumsum(sizes)
                empty = counts == 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[: len(keep)], pa.array(text_keys(counts, index, hashes), pa.binary()),
                        pa.array([None if e else x for e, x in zip(empty, lists.to_pylist(), strict=True)], pa.list_(pa.int64())) if empty.any() else lists,
                        pa.array([small[e - s : e].tobytes() for e, s in zip(ends, sizes, strict=True)], pa.binary()),
                    ],
                    names=[*keep, "key", "bands", "shingles"],
                )
            give_back()

    types = asked.schema
    return asked.mapInArrow(run, ", ".join(f"`{c}` {types[c].dataType.simpleString()}" for c in keep) + ", key binary, bands array<long>, shingles binary")


def overlap(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)) - 1:
        return 0.0  # the sizes alone rule it out
    both = np.sort(np.concatenate([x, y]))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(x) + len(y) - common)


def _needed(signed: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, s): one shingle list for each of the distinct ``keys``; those of other classes are not moved."""
    ids = materialise(keys.distinct(), "dedup-ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return materialise(signed.select("key", "shingles").join(side, "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("s")), "dedup-sets")


def verify(pairs: DataFrame, signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of keys with a similarity of at least ``threshold``."""
    sets = _needed(signed, pairs.select(F.explode(F.array("a", "b")).alias("key")))
    joined = pairs.select("a", "b").join(sets.withColumnRenamed("key", "a").withColumnRenamed("s", "x"), "a")
    joined = joined.join(sets.withColumnRenamed("key", "b").withColumnRenamed("s", "y"), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            close = [overlap(x[i].as_buffer(), y[i].as_buffer()) >= threshold for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), names=["a", "b"]).filter(pa.array(close, pa.bool_()))

    return materialise(joined.mapInArrow(run, "a binary, b binary"), "dedup-links")


def cell_links(keys: list[bytes], comps: list[bytes], sets: list[bytes], minor: np.ndarray, threshold: float) -> list[tuple[bytes, bytes]]:
    """Links from the minor rows to the others, one for each two components that they join."""
    parent: dict[bytes, bytes] = {}

    def root(c: bytes) -> bytes:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    lists = [np.frombuffer(x, "<u4") for x in sets]
    others = np.flatnonzero(~minor)
    if not len(others):
        return []
    sizes = np.asarray([len(x) for x in lists])
    every = np.concatenate([lists[o] for o in others])
    owner = np.repeat(others, sizes[others])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    out = []
    for m in np.flatnonzero(minor):
        low, high = np.searchsorted(every, lists[m], "left"), np.searchsorted(every, lists[m], "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(lists))
        for j in np.flatnonzero(common >= threshold * (sizes[m] + sizes - common)):
            a, b = root(comps[m]), root(comps[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((keys[m], keys[j]))
    return out


def cross_links(members: DataFrame, joined: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """Links between members of a bucket that lie in different components. Links to a bucket's leader are known."""
    of = members.where("key <> leader").select("bucket", "key").join(joined.withColumnRenamed("node", "key"), "key", "left")
    of = materialise(of.select("bucket", "key", F.coalesce("component", "key").alias("c")), "dedup-of")
    per = of.groupBy("bucket", "c").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("many"))
    cells = per.where("many > 1").select(
        "bucket", F.col("top.c").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / MINORS).cast("int").alias("ni"), F.ceil(F.col("n") / OTHERS).cast("int").alias("nj")
    )
    cells = materialise(cells, "dedup-cells")
    total = cells.agg(F.coalesce(F.sum(F.col("ni") * F.col("nj")), F.lit(0))).first()[0]
    if not total:
        return signed.sparkSession.createDataFrame([], "a binary, b binary")
    rows = of.join(cells, "bucket")
    block = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    minors = rows.where("c <> top").select("bucket", "key", "c", F.lit(True).alias("minor"), block("ni").alias("i"), "nj").withColumn("j", each("nj")).drop("nj")
    others = rows.select("bucket", "key", "c", F.lit(False).alias("minor"), block("nj").alias("j"), "ni").withColumn("i", each("ni")).drop("ni")
    placed = minors.unionByName(others)
    bundles = max(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // CELLS)
    placed = materialise(placed.withColumn("bundle", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(bundles)).cast("int")), "dedup-placed")
    sets = _needed(signed, placed.select("key"))

    def run(group: pa.Table) -> pa.Table:
        found: list[tuple[bytes, bytes]] = []
        group = group.sort_by([("bucket", "ascending"), ("i", "ascending"), ("j", "ascending")]).combine_chunks()
        at = np.stack([group[c].to_numpy() for c in ("bucket", "i", "j")], axis=1)
        starts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            part = group.slice(a, b - a)
            found += cell_links(part["key"].to_pylist(), part["c"].to_pylist(), part["s"].to_pylist(), np.asarray(part["minor"].to_pylist(), bool), threshold)
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return placed.join(sets, "key").groupBy("bundle").applyInArrow(run, "a binary, b binary")


def components(signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) of the keys that have links to other keys."""
    classes = materialise(signed.where("bands is not null").groupBy("key").agg(F.first("bands").alias("bands")), "dedup-classes")
    banded = classes.select("key", F.explode("bands").alias("bucket"))
    # written first, so that a join with it is one of two plain shuffles, which adaptive execution splits at hot buckets
    shared = materialise(banded.groupBy("bucket").agg(F.min("key").alias("leader"), F.max("key").alias("last")).where("leader <> last"), "dedup-shared")
    members = materialise(banded.join(shared.select("bucket", "leader"), "bucket"), "dedup-members")
    stars = members.where("key <> leader").groupBy(F.col("key").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("n"))
    stars = materialise(stars, "dedup-stars")
    best = stars.groupBy("a").agg(F.max(F.struct("n", "b")).alias("m")).select("a", F.col("m.b").alias("b"))

    def grown(joined: DataFrame | None, more: DataFrame) -> DataFrame:
        """Components with more links; what is joined already goes on as one link per member."""
        if joined is not None:
            more = more.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return materialise(connected_components(more), "dedup-joined")

    joined = grown(None, verify(best, signed, threshold))
    name = lambda side: joined.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    rest = stars.select("a", "b").join(best, ["a", "b"], "left_anti").join(name("a"), "a", "left").join(name("b"), "b", "left")
    rest = materialise(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "dedup-rest")
    if not rest.isEmpty():
        joined = grown(joined, verify(rest, signed, threshold))
    last = materialise(cross_links(members, joined, signed, threshold), "dedup-last")
    return joined if last.isEmpty() else grown(joined, last)


def classified(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, row_col: str | None = None) -> DataFrame:
    """Rows (rid, id, key, class: key of the class, first: struct of the row that stays, members).

    ``row_col`` names a column that numbers the rows, where the caller has one.
    """
    number = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    with rounds(documents.sparkSession) as keep:
        signed = materialise(sign(documents.select(number.alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", ["rid", "id"]), "dedup-signed")
        joined = materialise(components(signed, threshold), "dedup-components")
        rows = signed.select("rid", "id", "key").join(joined.select(F.col("node").alias("key"), F.col("component").alias("class")), "key", "left")
        rows = keep(materialise(rows.withColumn("class", F.coalesce("class", "key")), "dedup-rows"))
        rank = F.struct(F.col("id").isNull().alias("n"), "id", "rid")
        # written first, so that the join is one of two plain shuffles, which adaptive execution splits at a large class
        first = keep(materialise(rows.groupBy("class").agg(F.min(rank).alias("first"), F.count("*").alias("members")), "dedup-first"))
    return rows.join(first, "class")


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("id").alias("doc_id"), F.col("first.id").alias("class_id"), F.col("members").alias("class_size"), (F.col("rid") == F.col("first.rid")).alias("kept")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    plain, of = plain_names(docs)
    plain = materialise(plain.withColumn("rid", F.monotonically_increasing_id()), "dedup-docs")
    with rounds(spark) as keep:
        gone = classified(plain, of["doc_id"], of["text"], row_col="rid").where("rid <> first.rid").select("rid")
        gone = keep(materialise(gone, "dedup-gone"))
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS * 5 else gone
    return own_names(plain.join(side, "rid", "left_anti"), of)


#: Exact weighted Jaccard similarity of all texts that share a shingle, components by handing on the rows that can be reached; for small tables.
OP10_SQL = f"""WITH RECURSIVE texts AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST) AS r,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 rows AS (SELECT doc_id, r, w, min(r) OVER (PARTITION BY array_to_string(w, ' ')) AS node FROM texts),
 runs AS (SELECT node, unnest([array_to_string(w[i:i + {SHINGLE - 1}], ' ') FOR i IN range(1, greatest(len(w) - {SHINGLE - 2}, 2))]) AS s FROM rows WHERE r = node AND len(w) > 0),
 weights AS (SELECT node, s, count(*) AS n FROM runs GROUP BY node, s), sizes AS (SELECT node, sum(n) AS n FROM weights GROUP BY node),
 shared AS (SELECT a.node AS a, b.node AS b, sum(least(a.n, b.n)) AS n FROM weights a JOIN weights b ON a.s = b.s AND a.node <> b.node GROUP BY 1, 2),
 links AS (SELECT a, b FROM shared h JOIN sizes x ON x.node = a JOIN sizes y ON y.node = b WHERE h.n >= {THRESHOLD} * (x.n + y.n - h.n)),
 reach(node, seen) AS (SELECT a, a FROM links UNION SELECT l.b, e.seen FROM reach e JOIN links l ON l.a = e.node WHERE e.seen < l.b),
 low AS (SELECT node, min(seen) AS low FROM reach GROUP BY node),
 classes AS (SELECT doc_id, r, coalesce(low, rows.node) AS class FROM rows LEFT JOIN low ON low.node = rows.node)
 SELECT c.doc_id, f.doc_id AS class_id, count(*) OVER (PARTITION BY c.class) AS class_size, c.r = c.class AS kept FROM classes c JOIN texts f ON f.r = c.class"""
