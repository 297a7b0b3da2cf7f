"""Interpolated modified Kneser-Ney model of order two or three, counted in Spark, looked up in sorted hash arrays.

1. Words of the training rows are hashed to 64 bits and counted per task, then by hash range; each
   range writes its sorted hashes and counts as plain arrays. A word's id is its place in them.
2. Order two: pairs of ids are counted the same way under a reversible mix, so that pairs of a frequent
   word spread over all ranges. Each range writes its sorted keys and counts, and passes on sums by
   first and by second word, which are added up by range of ids and written as dense arrays.
   Order three: triples are counted by the mixed pair of their last two words. Each range writes its
   sorted pairs, where the triples of each begin, and the triples' first words and counts; a pair's number
   of triples is its continuation count. A second job reads these arrays and adds up the sums by word as
   above, and by context (the first two words) into arrays beside the pairs.
3. Workers memory-map these arrays and score whole texts. A text begins with one start, or with two.

The arrays lie in the folder that all executors share (on other stores than a file system, a worker
reads the range it needs). Everything that crosses a shuffle is one compressed block per task and
range, already summed, and no range depends on how often a single word occurs. The driver receives
a few sums per range.

Words and pairs are told apart by 64-bit hashes. Defined cases: a null text is empty and consists of
the end alone; with no training rows every probability is the uniform 1 / (V + 1); repeated rows
count, and are scored, each.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import fold, table
from mosaiq.llm.store import Store
from mosaiq.plans.scratch import fresh_path
from mosaiq.plans.ship import ship

#: A word never holds a space, so this hash belongs to the end alone.
END = xxhash.xxh3_64_intdigest(b" end")
#: A task sums up its counts whenever it has seen this many tokens.
FLUSH_TOKENS = 1_500_000
#: A range of pairs, and one of triples, stands for about so many tokens of the corpus, so that no task grows with it.
RANGE_TOKENS, RANGE_TRIPLES = 8_000_000, 4_000_000
#: Texts read at a time, so that a worker's memory does not follow the size of Spark's batches.
ROWS = 2000

U64, BLOCK = np.uint64, "part int, keys binary, values binary"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, index of each word into the hashes, hashes of the distinct words)."""
    # a copy that begins at offset 0: lowering a slice of another array gives wrong letters in pyarrow 23
    texts = pa.concat_arrays([texts.slice(0, 0), texts])
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    flat, bounds = lists.flatten(), np.diff(lists.offsets.to_numpy())
    full = pc.greater(pc.binary_length(flat), 0)
    mask = full.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(bounds)), bounds)[mask]
    words = flat.filter(full).dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for w in words.dictionary.to_pylist()), U64, len(words.dictionary))
    return np.bincount(owner, minlength=len(bounds)), words.indices.to_numpy(zero_copy_only=False), hashes


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def streams(begin: int, end: int, of: np.ndarray, counts: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id two places before, previous id, id, text) of every token, the end included, for words ``of[index]``."""
    doc = np.repeat(np.arange(len(counts)), counts + 1)
    last = np.cumsum(counts + 1) - 1
    now = np.empty(len(doc), of.dtype)
    is_word = np.ones(len(doc), bool)
    is_word[last] = False
    now[is_word], now[last] = of[index], end
    starts = np.diff(doc, prepend=-1) != 0
    before = np.where(starts, of.dtype.type(begin), np.roll(now, 1))
    return np.where(starts, of.dtype.type(begin), np.roll(before, 1)), before, now, doc


#: Odd factors of the mix.
FACTORS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix(x: np.ndarray, width: int = 32) -> np.ndarray:
    """A reversible mix of two numbers of ``width`` bits each, standing side by side."""
    half, keep = U64(width), U64(2 ** (2 * width) - 1)
    for k in FACTORS:
        x = (x ^ (x >> half)) * U64(k) & keep
    return x ^ (x >> half)


def unmix(x: np.ndarray, width: int = 32) -> np.ndarray:
    half, keep = U64(width), U64(2 ** (2 * width) - 1)
    for k in reversed(FACTORS):
        x = (x ^ (x >> half)) * U64(pow(k, -1, 2**64)) & keep
    return x ^ (x >> half)


def part_of(keys: np.ndarray, parts: int, width: int = 32) -> np.ndarray:
    """Ranges of equal width over keys of twice ``width`` bits, in order."""
    return (((keys << U64(64 - 2 * width)) >> U64(32)) * U64(parts)) >> U64(32)


def pack(values: np.ndarray) -> bytes:
    """Planes of bytes, compressed; sorted 64-bit keys are packed as differences."""
    if values.dtype == U64 and len(values):
        values = np.diff(values, prepend=U64(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else values
    return zstandard.compress(planes.tobytes(), 1)


def unpack(block: bytes, dtype, width: int = 1) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(block), np.uint8)
    size = np.dtype(dtype).itemsize * width
    values = np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)
    return np.cumsum(values, dtype=U64) if dtype == U64 else (values.reshape(-1, width) if width > 1 else values)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of the rows of values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    if not len(keys):
        return keys, values
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return keys[starts], np.add.reduceat(values, starts, axis=0)


def summed_triples(keys: np.ndarray, left: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of key and left word, by key and then left word, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, left, counts = keys[order], left[order], counts[order]
    if not len(keys):
        return keys, left, counts
    rank = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]])).astype(U64)
    within_keys = (rank << U64(32)) | left.astype(U64)
    order = np.argsort(within_keys, kind="stable")
    within_keys = within_keys[order]
    starts = np.concatenate([[0], np.flatnonzero(within_keys[1:] != within_keys[:-1]) + 1])
    return keys[order[starts]], left[order[starts]], np.add.reduceat(counts[order], starts)


def within(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Place of each asked value in its span of ``values``, which is in order; -1 where it isn't there."""
    end, lo, hi = hi, lo.copy(), hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        less = values[mid] < asked[live]
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]
        live = live[lo[live] < hi[live]]
    found = np.flatnonzero(lo < end)
    found = found[values[lo[found]] == asked[found]]
    out = np.full(len(asked), -1)
    out[found] = lo[found]
    return out


def write_small(store: Store, name: str, values: np.ndarray) -> int:
    """Write counts as bytes, those of 255 and more beside them; the number of these."""
    over = np.flatnonzero(values >= 255)
    store.write(name, np.minimum(values, 255).astype(np.uint8))
    store.write(f"{name}-at", over.astype(np.int64))
    store.write(f"{name}-of", values[over].astype(np.int64))
    return len(over)


@contextmanager
def shuffles_end(spark: SparkSession):
    """Queries built and run here delete their shuffle files when they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def blocks(keys: np.ndarray, values: np.ndarray, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each part of keys that are in order."""
    found, starts = np.unique(parts, return_index=True)
    ends = [*starts[1:], len(keys)]
    rows = [(int(p), pack(keys[a:b]), pack(values[a:b])) for p, a, b in zip(found, starts, ends, strict=True)]
    if rows:
        part, k, v = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(k, pa.binary()), pa.array(v, pa.binary())], names=["part", "keys", "values"])


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the sums that scoring needs; some hundred numbers per range at most."""

    uri: str
    parts: int
    first: tuple[int, ...]  # id of each range's first word, and V at the end
    order: int = 2
    pairs: tuple[int, ...] = ()  # distinct pairs of each range, negative where a count is beyond 32 bits
    total: int = 0
    discount: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    lower: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    continued: int = 0
    floor: float = 0.0
    triples: tuple[tuple[int, int], ...] = ()  # triples of each range, and counts of 255 and more
    contexts: tuple[tuple[int, ...], ...] = ()  # of each range's four sums by context, how many are 255 and more; empty without contexts
    top: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    _kept: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_kept"} | {"_kept": {}}

    @property
    def vocabulary(self) -> int:
        return self.first[-1]

    @property
    def width(self) -> int:
        """Bits of an id, those of the start and of words not seen included."""
        return max(8, (self.vocabulary + 1).bit_length())

    def array(self, name: str, dtype, n: int) -> np.ndarray:
        if name not in self._kept:
            self._kept[name] = Store(self.uri).array(name, dtype, n)
        return self._kept[name]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words; V + 1 for words not seen (V stands for the start of a text)."""
        order = np.argsort(hashes)
        out = np.full(len(hashes), self.vocabulary + 1, U64)
        asked = hashes[order]
        cuts = np.searchsorted(part_of(asked, self.parts), np.arange(self.parts + 1))
        for p in range(self.parts):
            n, some = self.first[p + 1] - self.first[p], slice(cuts[p], cuts[p + 1])
            if n and some.start < some.stop:
                keys = self.array(f"words-{p}", U64, n)
                at = np.minimum(np.searchsorted(keys, asked[some]), n - 1)
                out[order[some]] = np.where(keys[at] == asked[some], U64(self.first[p]) + at.astype(U64), out[order[some]])
        return out

    def by_id(self, name: str, dtype, ids: np.ndarray) -> np.ndarray:
        """Entries of a dense array for ids in order; 0 for words not seen."""
        out = np.zeros(len(ids), dtype)
        cuts = np.searchsorted(ids, np.asarray(self.first, U64))
        for p in range(self.parts):
            last = p == self.parts - 1
            n, some = self.first[p + 1] - self.first[p] + last, slice(cuts[p], np.searchsorted(ids, U64(self.vocabulary), "right") if last else cuts[p + 1])
            if n and some.start < some.stop:
                out[some] = self.array(f"{name}-{p}", dtype, n)[(ids[some] - U64(self.first[p])).astype(np.int64)]
        return out

    def small(self, name: str, n: int, over: int, at: np.ndarray) -> np.ndarray:
        """Entries of an array of counts that was written small."""
        out = self.array(name, np.uint8, n)[at].astype(np.int64)
        big = np.flatnonzero(out == 255)
        if len(big):
            out[big] = self.array(f"{name}-of", np.int64, over)[np.searchsorted(self.array(f"{name}-at", np.int64, over), at[big])]
        return out

    def places(self, mixed: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(range, which of the mixed pairs in order it holds, their places in it)."""
        cuts = np.searchsorted(part_of(mixed, len(self.pairs), self.width), np.arange(len(self.pairs) + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            n = abs(self.pairs[p])
            if n:
                keys, asked = self.array(f"pairs-{p}", U64, n), mixed[cuts[p] : cuts[p + 1]]
                at = np.minimum(np.searchsorted(keys, asked), n - 1)
                found = np.flatnonzero(keys[at] == asked)
                yield p, cuts[p] + found, at[found]

    def spans(self, p: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the triples of pairs begin and end."""
        starts = self.array(f"starts-{p}", np.uint32, self.pairs[p] + 1)
        return starts[at].astype(np.int64), starts[at + 1].astype(np.int64)

    def pair_counts(self, mixed: np.ndarray) -> np.ndarray:
        """Counts of mixed pairs in order; at order three, the numbers of words that precede them."""
        out = np.zeros(len(mixed), np.int64)
        for p, some, at in self.places(mixed):
            if self.order == 3:
                lo, hi = self.spans(p, at)
                out[some] = hi - lo
            else:
                out[some] = self.array(f"pair-counts-{p}", np.uint32 if self.pairs[p] > 0 else np.int64, abs(self.pairs[p]))[at]
        return out

    def triple_counts(self, mixed: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Counts of triples by the mixed pairs, in order, of their last words, and by their first words."""
        out = np.zeros(len(mixed), np.int64)
        for p, some, at in self.places(mixed):
            n, over = self.triples[p]
            place = within(self.array(f"left-{p}", np.uint32, n), *self.spans(p, at), left[some])
            seen = np.flatnonzero(place >= 0)
            out[some[seen]] = self.small(f"triple-counts-{p}", n, over, place[seen])
        return out

    def context_sums(self, mixed: np.ndarray) -> list[np.ndarray]:
        """Sum of counts, and number of triples seen once, twice and more, by context, for mixed pairs in order."""
        out = [np.zeros(len(mixed), np.int64) for _ in range(4)]
        for p, some, at in self.places(mixed):
            for i, over in enumerate(self.contexts[p]):
                out[i][some] = self.small(f"context-{i}-{p}", self.pairs[p], over, at)
        return out

    def log10(self, left: np.ndarray, before: np.ndarray, now: np.ndarray) -> np.ndarray:
        """log10 P(now | left, before), or at order two P(now | before); each distinct pair and triple is looked up once."""
        width = U64(self.width)
        pairs, back = np.unique(mix((before << width) | now, self.width), return_inverse=True)
        counts = self.pair_counts(pairs)
        plain = unmix(pairs, self.width)
        first, at_first = np.unique(plain >> width, return_inverse=True)
        second, at_second = np.unique(plain & U64(2**self.width - 1), return_inverse=True)
        follows = self.by_id("follows", np.int64, second)
        low = np.maximum(follows - np.asarray(self.lower)[np.minimum(follows, 3)], 0) / max(self.continued, 1) + self.floor
        some = _interpolated(counts, [self.by_id(name, np.int64, first) for name in ("c", "n1", "n2", "n3")], at_first, self.discount, low[at_second])
        if self.order == 2:
            return np.log10(some)[back]
        triples, back = np.unique((back.astype(U64) << U64(32)) | left, return_inverse=True)
        of, left = (triples >> U64(32)).astype(np.int64), triples & U64(0xFFFFFFFF)
        contexts, at = np.unique(mix((left << width) | (plain >> width)[of], self.width), return_inverse=True)
        return np.log10(_interpolated(self.triple_counts(pairs[of], left), self.context_sums(contexts), at, self.top, some[of]))[back]


def _interpolated(counts: np.ndarray, sums: list[np.ndarray], at: np.ndarray, d: tuple[float, ...], low: np.ndarray) -> np.ndarray:
    """Discounted counts over their contexts' sums, which stand at ``at``, and what the discounts free times the lower order."""
    seen = np.maximum(sums[0], 1)
    back_off = np.where(sums[0] > 0, (d[1] * sums[1] + d[2] * sums[2] + d[3] * sums[3]) / seen, 1.0)
    return np.maximum(counts - np.asarray(d)[np.minimum(counts, 3)], 0) / seen[at] + back_off[at] * low


def discounts(n: np.ndarray) -> tuple[float, ...]:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more from the counts of counts n[1..4]; absolute 0.5 where those are too few."""
    if min(n[1:5]) <= 0:
        return (0.0, 0.5, 0.5, 0.5)
    y = n[1] / (n[1] + 2 * n[2])
    return (0.0, *(float(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05)) for k in (1, 2, 3)))


def _merged(group: pa.Table, dtype, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    keys = [unpack(x.as_py(), U64) for x in group["keys"]]
    values = [unpack(x.as_py(), dtype, width) for x in group["values"]]
    return summed(np.concatenate(keys), np.concatenate(values).astype(np.int64))


def train(rows: DataFrame, text_col: str, parts: int, order: int = 3) -> Model:
    """Count the texts of ``rows``; ``parts`` is the number of ranges of words, and the least number of ranges of pairs, which grows with the corpus.

    ``order`` is two or three.
    """
    if order not in (2, 3):
        raise ValueError("the order is two or three")
    spark = rows.sparkSession
    ship(spark)
    uri = fresh_path(spark, "lm")
    texts = rows.select(F.col(text_col).alias("t"))

    def count_words(batches):
        keys, counts, held = [], [], 0
        for batch in slices(batches):
            per, index, hashes = tokens(batch.column(0))
            keys += [hashes, np.asarray([END], U64)]
            counts += [np.bincount(index, minlength=len(hashes)), np.asarray([len(per)])]
            held += len(index)
            if held > FLUSH_TOKENS:
                k, c = summed(np.concatenate(keys), np.concatenate(counts).astype(np.int64))
                yield from blocks(k, c, part_of(k, parts))
                keys, counts, held = [], [], 0
        if keys:
            k, c = summed(np.concatenate(keys), np.concatenate(counts).astype(np.int64))
            yield from blocks(k, c, part_of(k, parts))

    def write_words(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        keys, counts = _merged(group, np.int64)
        keep = counts > 0
        keys, counts = keys[keep], counts[keep]
        Store(uri).write(f"words-{part}", keys)
        Store(uri).write(f"word-counts-{part}", counts)
        return pa.table({"part": pa.array([part], pa.int32()), "n": [len(keys)], "tokens": [int(counts.sum())]})

    with shuffles_end(spark):
        counted = texts.mapInArrow(count_words, BLOCK).groupBy("part").applyInArrow(write_words, "part int, n long, tokens long")
        sizes = {r["part"]: r for r in counted.collect()}  # one row per range
    first = np.concatenate([[0], np.cumsum([sizes[p]["n"] if p in sizes else 0 for p in range(parts)])])
    model = Model(uri, parts, tuple(int(x) for x in first), order, (), sum(r["tokens"] for r in sizes.values()))
    begin, width = model.vocabulary, model.width
    if begin >= 2**32 - 2:
        raise ValueError("ids of words must fit 32 bits")
    pair_parts = max(parts, -(-model.total // (RANGE_TOKENS if order == 2 else RANGE_TRIPLES)))

    def count_pairs(batches):
        keys, held = [], 0
        end = int(model.ids(np.asarray([END], U64))[0])

        def flush():
            k, c = np.unique(np.concatenate(keys), return_counts=True)
            return blocks(k, c.astype(np.uint32), part_of(k, pair_parts, width))

        for batch in slices(batches):
            per, index, hashes = tokens(batch.column(0))
            if len(per):
                _, before, now, _ = streams(begin, end, model.ids(hashes), per, index)
                keys.append(mix((before << U64(width)) | now, width))
                held += len(now)
            if held > FLUSH_TOKENS:
                yield from flush()
                keys, held = [], 0
        if keys:
            yield from flush()

    def count_triples(batches):
        keys, lefts, held = [], [], 0
        end = int(model.ids(np.asarray([END], U64))[0])
        start = mix(np.asarray([begin << width | begin], U64), width)

        def flush():
            k, left, c = summed_triples(np.concatenate(keys), np.concatenate(lefts), np.ones(held, np.int64))
            at = np.searchsorted(k, start)  # the context of first words, which ends no triple: a place for its sums, no count
            k, left, c = np.insert(k, at, start), np.insert(left, at, 0), np.insert(c, at, 0)
            return blocks(k, np.stack([left, c.astype(np.uint32)], axis=1), part_of(k, pair_parts, width))

        for batch in slices(batches):
            per, index, hashes = tokens(batch.column(0))
            if len(per):
                left, before, now, _ = streams(begin, end, model.ids(hashes), per, index)
                keys.append(mix((before << U64(width)) | now, width))
                lefts.append(left.astype(np.uint32))
                held += len(now)
            if held > FLUSH_TOKENS:
                yield from flush()
                keys, lefts, held = [], [], 0
        if keys:
            yield from flush()

    bounds = np.asarray(model.first[1:-1], U64)
    shape = "kind int, part int, keys binary, values binary"

    def row(kind: int, part: int, stats: list[int]) -> pa.Table:
        values = np.asarray(stats, np.int64).tobytes()
        return pa.table({"kind": pa.array([kind], pa.int32()), "part": pa.array([part], pa.int32()), "keys": pa.array([b""], pa.binary()), "values": pa.array([values], pa.binary())})

    def of_kind(kind: int, some: Iterator[pa.RecordBatch]) -> list[pa.Table]:
        return [pa.table({"kind": pa.array([kind] * b.num_rows, pa.int32())} | {n: b.column(n) for n in ("part", "keys", "values")}) for b in some]

    def by_word(keys: np.ndarray, counts: np.ndarray) -> list[pa.Table]:
        """Sums of distinct pairs by first and by second word."""
        plain, out = unmix(keys, width), []
        of_first = np.stack([counts, counts == 1, counts == 2, counts >= 3], axis=1).astype(np.int64)
        for kind, ids, values in ((0, plain >> U64(width), of_first), (1, plain & U64(2**width - 1), np.ones((len(keys), 1), np.int64))):
            k, v = summed(ids, values)
            out += of_kind(kind, blocks(k, v, np.searchsorted(bounds, k, "right")))
        return out

    def often(counts: np.ndarray) -> list[int]:
        return [int((counts == i).sum()) for i in (1, 2, 3, 4)]

    def write_pairs(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        keys, counts = _merged(group, np.uint32)
        Store(uri).write(f"pairs-{part}", keys)
        wide = len(counts) and counts.max() >= 2**32
        Store(uri).write(f"pair-counts-{part}", counts if wide else counts.astype(np.uint32))
        return pa.concat_tables([*by_word(keys, counts), row(2, part, [-len(keys) if wide else len(keys), *often(counts)])])

    def write_triples(group: pa.Table) -> pa.Table:
        part, store = group["part"][0].as_py(), Store(uri)
        values = np.concatenate([unpack(x.as_py(), np.uint32, 2) for x in group["values"]])
        keys, left, counts = summed_triples(np.concatenate([unpack(x.as_py(), U64) for x in group["keys"]]), values[:, 0], values[:, 1].astype(np.int64))
        pairs, live = keys[np.diff(keys, prepend=~keys[:1]) != 0], counts > 0
        keys, left, counts = keys[live], left[live], counts[live]
        if len(keys) >= 2**32:
            raise ValueError("places within a range must fit 32 bits")
        store.write(f"pairs-{part}", pairs)
        store.write(f"starts-{part}", np.append(np.searchsorted(keys, pairs), len(keys)).astype(np.uint32))
        store.write(f"left-{part}", left)
        over = write_small(store, f"triple-counts-{part}", counts)
        return row(4, part, [len(pairs), len(keys), over, *often(counts)])

    def sums_of_triples(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                n, (m, over) = model.pairs[part], model.triples[part]
                if n:
                    keys, everything = np.asarray(model.array(f"pairs-{part}", U64, n)), np.arange(n)
                    lo, hi = model.spans(part, everything)
                    follows, live = hi - lo, hi > lo
                    counts = model.small(f"triple-counts-{part}", m, over, np.arange(m))
                    before = np.repeat(unmix(keys, width) >> U64(width), follows)
                    contexts = mix((model.array(f"left-{part}", np.uint32, m).astype(U64) << U64(width)) | before, width)
                    k, v = summed(contexts, np.stack([counts, counts == 1, counts == 2, counts >= 3], axis=1).astype(np.int64))
                    tables = [*by_word(keys[live], follows[live]), *of_kind(3, blocks(k, v, part_of(k, pair_parts, width))), row(2, part, [n, *often(follows)])]
                    model._kept.clear()
                    for t in tables:
                        yield from t.to_batches()

    def write_sums(group: pa.Table) -> pa.Table:
        kind, part = group["kind"][0].as_py(), group["part"][0].as_py()
        if kind == 2:
            return group
        keys, values = _merged(group.drop_columns("kind"), np.int64, 1 if kind == 1 else 4)
        if kind == 3:
            dense = np.zeros((4, model.pairs[part]), np.int64)
            dense[:, np.searchsorted(model.array(f"pairs-{part}", U64, model.pairs[part]), keys)] = values.T
            return row(3, part, [write_small(Store(uri), f"context-{i}-{part}", x) for i, x in enumerate(dense)])
        n = model.first[part + 1] - model.first[part] + (part == parts - 1)
        at = (keys - U64(model.first[part])).astype(np.int64)
        values = values.reshape(len(keys), -1)
        for name, column in zip(("c", "n1", "n2", "n3") if kind == 0 else ("follows",), values.T, strict=True):
            dense = np.zeros(n, np.int64)
            dense[at] = column
            Store(uri).write(f"{name}-{part}", dense)
        v = values[:, 0] if kind == 1 else np.zeros(0, np.int64)
        return row(kind, part, [int(v.sum()), *often(v), int((v >= 3).sum())])

    def collected(out: DataFrame) -> dict[tuple[int, int], np.ndarray]:
        """A few sums per range."""
        return {(r["kind"], r["part"]): np.frombuffer(bytes(r["values"]), np.int64) for r in out.collect()}

    top = (0.0, 0.0, 0.0, 0.0)
    with shuffles_end(spark):
        if order == 3:
            sizes = collected(texts.mapInArrow(count_triples, BLOCK).groupBy("part").applyInArrow(write_triples, shape))
            some = [[int(x) for x in sizes[4, p][:3]] if (4, p) in sizes else [0, 0, 0] for p in range(pair_parts)]
            model = replace(model, pairs=tuple(n for n, _, _ in some), triples=tuple((m, over) for _, m, over in some), _kept={})
            top = discounts(np.concatenate([[0], sum((x[3:] for x in sizes.values()), np.zeros(4, np.int64))]))
            paired = spark.range(0, pair_parts, 1, pair_parts).mapInArrow(sums_of_triples, shape)
        else:
            paired = texts.mapInArrow(count_pairs, BLOCK).groupBy("part").applyInArrow(write_pairs, shape)
        stats = collected(paired.groupBy("kind", "part").applyInArrow(write_sums, shape))
    pairs = tuple(int(stats[2, p][0]) if (2, p) in stats else 0 for p in range(pair_parts))
    of_pairs = sum((s for (k, _), s in stats.items() if k == 2), np.zeros(5, np.int64))
    of_follow = sum((s for (k, _), s in stats.items() if k == 1), np.zeros(6, np.int64))
    missing = [(n, p) for p in range(parts) for k, names in ((0, ("c", "n1", "n2", "n3")), (1, ("follows",))) if (k, p) not in stats for n in names]
    for name, p in missing:  # ranges of ids without any pair
        Store(uri).write(f"{name}-{p}", np.zeros(model.first[p + 1] - model.first[p] + (p == parts - 1), np.int64))
    lower, continued = discounts(of_follow[:5]), int(of_follow[0])
    spare = (lower[1] * of_follow[1] + lower[2] * of_follow[2] + lower[3] * of_follow[5]) / continued if continued else 1.0
    return replace(
        model,
        pairs=pairs,
        discount=discounts(of_pairs),
        lower=lower,
        continued=continued,
        floor=float(spare) / (model.vocabulary + 1),
        contexts=tuple(tuple(stats[3, p].tolist()) if (3, p) in stats else () for p in range(pair_parts)),
        top=top,
        _kept={},
    )


def score(rows: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", held_out: Column | None = None) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    asked = rows.select(F.col(id_col).alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col(text_col).alias("t"))
    ship(rows.sparkSession)
    kind = asked.schema["doc_id"].dataType.simpleString()

    def run(batches):
        end = int(model.ids(np.asarray([END], U64))[0])
        for batch in slices(batches):
            per, index, hashes = tokens(batch.column(2))
            left, before, now, doc = streams(model.vocabulary, end, model.ids(hashes), per, index)
            ids, back = np.unique(now, return_inverse=True)
            seen = _word_counts(model, ids)
            base = np.log10((seen + 1.0) / (model.total + 1.0 * (model.vocabulary + 1)))
            n = len(per)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(per + 1, pa.int64()),
                    pa.array(np.bincount(doc, weights=(seen > 0)[back], minlength=n).astype(np.int64)),
                    pa.array(np.full(n, model.total, np.int64)),
                    pa.array(np.bincount(doc, weights=base[back], minlength=n)),
                    pa.array(np.bincount(doc, weights=model.log10(left, before, now), minlength=n)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return asked.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _word_counts(model: Model, ids: np.ndarray) -> np.ndarray:
    """Training counts of ids in order; 0 for words not seen."""
    out = np.zeros(len(ids), np.int64)
    cuts = np.searchsorted(ids, np.asarray(model.first, U64))
    for p in range(model.parts):
        n, some = model.first[p + 1] - model.first[p], slice(cuts[p], cuts[p + 1])
        if n and some.start < some.stop:
            out[some] = model.array(f"word-counts-{p}", np.int64, n)[(ids[some] - U64(model.first[p])).astype(np.int64)]
    return out


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 7) == 2
    model = train(documents.where(~held), "text", int(spark.conf.get("spark.sql.shuffle.partitions")))
    return score(documents, model, held_out=held)
