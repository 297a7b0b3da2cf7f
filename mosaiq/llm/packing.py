"""Best-fit packing of tokenised documents by matching large items.

Packing is decided on counts. There are at most ``capacity`` different lengths, so the plan is made
on the driver from one number per length, whatever the number of documents:

* pieces above half the capacity take the longest partner above a third that still fits, and the
  remaining ones above a third pair with each other, so that a sequence holds at most two of them;
* lengths up to a third follow in falling order, each into the tightest gap that holds it.

The plan says for each length which ranks among the pieces of that length go to which sequences.
A piece's rank is its rank within its task plus the count of that length in earlier tasks. No
piece is moved or sorted for it, and the plan's size depends on the capacity alone.

Defined cases: a null text is empty and consists of the end id alone; repeated rows are documents of
their own; an empty table gives an empty result. Documents above the capacity are cut into pieces of
the capacity, the first of them shorter if need be.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import give_back, table
from mosaiq.llm.store import Store
from mosaiq.plans.scratch import fresh_path, materialise
from mosaiq.plans.ship import ship

CAPACITY, END_ID = 2048, 0
#: A worker remembers the ids of at most this many chunks, none longer than so many characters.
KEPT_CHUNKS, KEPT_LENGTH = 600_000, 64
#: Texts are encoded in slices of about so many bytes.
SLICE_BYTES = 4_000_000
#: White space of any kind, and texts where it does not stand alone (or that hold the mark used for cutting).
WHITE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ODD = rf"[ \n][{WHITE}]|[{WHITE}]\n|\x{{00}}"
#: Chunks that begin with a blank, have visible characters beside it and at the end, and no line end.
PLAIN = rf"^ [^{WHITE}](?:[^\n]*[^{WHITE}])?$"
STOPPED = r"^[^\n]*\pL[.,;:!?]$"
#: Prefix sums of so many tasks lie in one file.
BUNDLE = 64
_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole batches. This tokenizer's splitting rule always begins a new unit at a blank before a
    visible character, and makes a unit of a line end between visible characters, so texts are cut there
    by Arrow and only chunks that are new to this worker are encoded. Chunk 0 is the end."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.token_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # a token's letters stand for one byte each
        for token, i in self.tokenizer.get_vocab().items():
            self.token_bytes[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.kept: dict[str, int] = {}
        self.pool, self.first, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.chunks = self.ids = 0
        self.add([""], np.asarray([END_ID], np.uint32), np.asarray([1]))
        self.kept.clear()

    def raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Number chunks whose ids stand one after another."""
        while self.ids + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.chunks + len(chunks) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        own = slice(self.chunks, self.chunks + len(chunks))
        self.pool[self.ids : self.ids + len(ids)] = ids
        self.first[own], self.size[own] = self.ids + np.cumsum(sizes) - sizes, sizes
        self.kept.update(zip(chunks, range(own.start, own.stop), strict=True))
        self.chunks, self.ids = own.stop, self.ids + len(ids)

    def learn(self, chunks: pa.Array) -> None:
        """Encode new chunks: those that begin with a blank joined, as each begins a new unit; the bytes of their ids part them again.
        A stop after a letter is a unit of its own, so a word is encoded once, with or without one."""
        stopped = pc.match_substring_regex(chunks, STOPPED)
        if pc.any(stopped, min_count=0).as_py():
            whole = chunks.filter(stopped)
            parts = [pc.utf8_slice_codeunits(whole, 0, -1), pc.utf8_slice_codeunits(whole, -1, None)]
            names = [x.to_numpy(zero_copy_only=False).tolist() for x in (*parts, whole)]
            others = pa.concat_arrays([chunks.filter(pc.invert(stopped)), *parts]).unique()
            known = np.fromiter((c in self.kept for c in others.to_numpy(zero_copy_only=False).tolist()), bool, len(others))
            self.learn(others.filter(pa.array(~known)))
            pairs = np.asarray([[self.kept[c] for c in x] for x in names[:2]], np.int64).T
            self.add(names[2], self.gather(pairs.reshape(-1)), self.size[pairs].sum(1))
            return
        plain = pc.match_substring_regex(chunks, PLAIN)
        some = chunks.filter(plain)
        names, ends = some.to_numpy(zero_copy_only=False).tolist(), np.cumsum(pc.binary_length(some).to_numpy(zero_copy_only=False), dtype=np.int64)
        if names:
            found = np.concatenate(self.raw(["".join(names[i : i + 200]) for i in range(0, len(names), 200)]))
            upto = np.cumsum(self.token_bytes[found])
            at = np.searchsorted(upto, ends)
            if (upto[at] != ends).any():
                raise ValueError("the tokenizer does not begin a unit at a blank before a visible character")
            self.add(names, found, np.diff(at, prepend=-1))
        rest = chunks.filter(pc.invert(plain)).to_numpy(zero_copy_only=False).tolist()
        if rest:
            found = self.raw(rest)
            self.add(rest, np.concatenate(found), np.asarray([len(x) for x in found]))

    def gather(self, order: np.ndarray) -> np.ndarray:
        """The ids of chunks by number, one after another."""
        sizes = self.size[order]
        return self.pool[np.repeat(self.first[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(chunks of all texts in order, how many each has)."""
        texts = pa.concat_arrays([texts.slice(0, 0), texts]).cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        marked = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 ")
        lists = pc.split_pattern(marked, "\0")
        if not pc.any(odd, min_count=0).as_py():
            return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        is_odd = odd.to_numpy(zero_copy_only=False)
        rows = [self.cut_odd(texts[i].as_py()) for i in np.flatnonzero(is_odd)]
        many = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        # chunks of plain and of odd texts, put into the order of the texts
        plain_many = np.where(is_odd, 0, many)
        many = plain_many.copy()
        many[is_odd] = [len(r) for r in rows]
        flat = pa.concat_arrays([lists.filter(pc.invert(odd)).flatten(), pa.array([c for r in rows for c in r], pa.large_string())])
        start = np.where(is_odd, plain_many.sum() + np.cumsum(np.where(is_odd, many, 0)), np.cumsum(plain_many)) - many
        return flat.take(pa.array(np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum()))), many

    def cut_odd(self, text: str) -> list[str]:
        """Chunks of a text with white space side by side; one that holds a special token stays whole."""
        if any(s in text for s in self.special):
            return [text]
        parts = text.split(" ")
        out = parts[:1]
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end, and how many each has)."""
        if len(self.kept) > KEPT_CHUNKS:
            self.forget()
        flat, many = self.cut(texts)
        words = flat.dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter((self.kept.get(c, -1) for c in names), np.int64, len(names))
        new = number < 0
        if new.any():
            self.learn(words.dictionary.filter(pa.array(new)))
            own = [names[i] for i in np.flatnonzero(new).tolist()]
            number[new] = [self.kept[c] for c in own]
            for c in own:
                if len(c) > KEPT_LENGTH:
                    del self.kept[c]
        order = np.zeros(len(flat) + len(many), np.int64)
        last = np.cumsum(many + 1) - 1
        inner = np.ones(len(order), bool)
        inner[last] = False
        if len(flat):
            order[inner] = number[words.indices.to_numpy(zero_copy_only=False)]
        return self.gather(order), np.diff(np.cumsum(self.size[order])[last], prepend=0)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents of ``n`` ids each, one at least."""
    many = -(-n // capacity)
    of = np.repeat(np.arange(len(n)), many)
    piece = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    head = (n - (many - 1) * capacity)[of]  # the first piece
    return of, piece, np.where(piece > 0, head + (piece - 1) * capacity, 0), np.where(piece > 0, capacity, head)


def by_bytes(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about SLICE_BYTES; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - 1) // SLICE_BYTES
    starts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


def pieces(documents: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, task, local_rank[, ids])."""
    ship(documents.sparkSession)
    asked = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    kind = asked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ranks, task = encoder(tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for part in by_bytes(batch, 1):
                ids, n = enc.encode(part.column(1))
                of, piece, start, length = cut(n, capacity)
                ends = 4 * np.cumsum(length)
                raw = ids.astype("<u4").tobytes()
                view = memoryview(raw)
                crc = [zlib.crc32(view[b - 4 * m : b]) for b, m in zip(ends.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                sorted_length = length[order]
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.searchsorted(sorted_length, sorted_length) + ranks[sorted_length]
                ranks += np.bincount(length, minlength=capacity + 1)
                columns = {
                    "doc_id": part.column(0).take(pa.array(of)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()), "task": pa.array(np.full(len(of), task), pa.int32()), "local_rank": pa.array(rank, pa.int64()),
                }
                if keep_ids:
                    columns["ids"] = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            give_back()

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, local_rank long" + ", ids binary" * keep_ids
    return asked.mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, first rank, end rank, per sequence, first sequence, offset).

    Ranks first..end of a length go ``per sequence`` to consecutive sequences from ``first
    sequence`` on, at ``offset`` and after one another.
    """
    left = {n: c for n, c in counts.items() if c > 0 and n > 0}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, sequences)
    gaps: list[int] = []
    sequences = 0

    def place(length: int, per: int, first: int, many: int, items: int) -> None:
        """``items`` of a length into the ``many`` sequences from ``first`` on, whose gap starts where given."""
        out.append((length, used[length], used[length] + items, per, first, place.offset))
        used[length] += items
        left[length] -= items

    def open_gap(gap: int, first: int, many: int) -> None:
        if many and gap:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((first, many))

    third, half = capacity // 3, capacity // 2
    large = sorted((n for n in left if n > third), reverse=True)
    for a in large:
        while left[a]:
            partner = next((b for b in large if b <= capacity - a and b <= a and left[b] > (b == a)), None)
            if partner is None:
                many = left[a]
                place.offset = 0
                place(a, 1, sequences, many, many)
                open_gap(capacity - a, sequences, many)
            elif partner == a:
                many = left[a] // 2
                place.offset = 0
                place(a, 2, sequences, many, 2 * many)
                open_gap(capacity - 2 * a, sequences, many)
            else:
                many = min(left[a], left[partner])
                place.offset = 0
                place(a, 1, sequences, many, many)
                place.offset = a
                place(partner, 1, sequences, many, many)
                open_gap(capacity - a - partner, sequences, many)
            sequences += many
    for s in sorted((n for n in left if n <= third), reverse=True):
        while left[s]:
            at = bisect_left(gaps, s)
            if at == len(gaps):
                per = capacity // s
                open_gap(capacity, sequences, -(-left[s] // per))
                sequences += -(-left[s] // per)
                continue
            gap = gaps[at]
            first, many = groups[gap].pop()
            if not groups[gap]:
                del groups[gap], gaps[at]
            per = gap // s
            full = min(many, left[s] // per)
            place.offset = capacity - gap
            if full:
                place(s, per, first, full, per * full)
                open_gap(gap - per * s, first, full)
            rest = many - full
            if rest and left[s]:  # fewer than fit into one more sequence
                items = left[s]
                place(s, items, first + full, 1, items)
                open_gap(gap - items * s, first + full, 1)
                full, rest = full + 1, rest - 1
            open_gap(gap, first + full, rest)
    return out


def pack(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])."""
    spark = documents.sparkSession
    cut_up = materialise(pieces(documents, id_col, text_col, capacity, tokenizer or default_tokenizer(), keep_ids), "pack-pieces")
    per_task = cut_up.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = materialise(per_task.select("task", "length", "n", before.alias("before")), "pack-counts")
    totals = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row per length
    placed = np.asarray(sorted(plan(totals, capacity)), np.int64).reshape(-1, 6)
    big = int(placed[:, 2].max()) + 1 if len(placed) else 1
    keys = placed[:, 0] * big + placed[:, 1]
    uri, wide = fresh_path(spark, "pack-before"), capacity + 1

    def write(group: pa.Table) -> pa.Table:
        bundle = group["bundle"][0].as_py()
        task, length, value = (group[c].to_numpy().astype(np.int64) for c in ("task", "length", "before"))
        dense = np.zeros((BUNDLE, wide), np.int64)
        dense[task % BUNDLE, length] = value
        Store(uri).write(f"before-{bundle}", dense.reshape(-1))
        return pa.table({"bundle": pa.array([bundle], pa.int32())})

    # the ranks before each task, as arrays in the shared folder: neither pieces nor their ids are shuffled
    bundles = offsets.select((F.col("task") / BUNDLE).cast("int").alias("bundle"), "task", "length", "before").groupBy("bundle").applyInArrow(write, "bundle int")
    bundles.agg(F.count("*")).collect()
    names = [c for c in cut_up.columns if c not in ("task", "local_rank")]
    types = dict(cut_up.dtypes)

    def run(batches):
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            rank, length, task = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("local_rank", "length", "task"))
            rank = rank.copy()
            for b in np.unique(task // BUNDLE).tolist():
                if b not in kept:
                    kept.clear()
                    kept[b] = Store(uri).array(f"before-{b}", np.int64, BUNDLE * wide).reshape(BUNDLE, wide)
                own = task // BUNDLE == b
                rank[own] += kept[b][task[own] % BUNDLE, length[own]]
            row = placed[np.searchsorted(keys, length * big + rank, "right") - 1] if len(rank) else placed[:0]
            past = rank - row[:, 1]
            columns = [batch.column(c) for c in names] + [pa.array(row[:, 4] + past // row[:, 3]), pa.array(row[:, 5] + past % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return cut_up.select(*names, "task", "local_rank").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in names) + ", sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences' pieces with their token ids."""
    return pack(docs, keep_ids=True)
