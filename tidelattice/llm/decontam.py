"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a run of documents of one partition: as many as have SHARD_WORDS symbols, or whose rows (with their texts, where these are carried
on) take SHARD_BYTES. Its words are coded over the alphabet of the benchmark's words;
a word outside that alphabet cannot lie in an occurrence and ends a run, as does the end of a text, and runs
shorter than the shortest window are left out, so that coding and index hold every place where a window can occur.
Over the coded shard we sort all suffixes (prefix doubling), take the Burrows-Wheeler transform, put it in a wavelet
matrix, search all windows backward at once through its ranks, locate occurrences by walking to sampled
suffix positions, and merge the occurrences of a document into removal spans.

Null and empty texts have no words and no hits, and very long ones are indexed in overlapping parts. Documents with null or repeated ids are rows of their own. Items of null id
count as one item, named null. Items that share an id are one item, and a window counts for each item that has it, so nothing depends on the order of ties. Without documents the result is empty, without
items there are no hits. Only key and text are read, so other columns may have any name.
A benchmark larger than `block_bytes` is searched in blocks, so that driver and tasks hold one; rows are then numbered, and the spans of a row's passes merged by that number.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import lean, materialise, small_batches
from .text import ALNUM, string_bytes, word_bounds

WINDOW = 13
SAMPLE = 8
#: Symbols after which an FM-index is closed, and bytes of the rows that wait for it.
SHARD_WORDS, SHARD_BYTES = 1 << 18, 8 << 20

_TABLE = bytearray(b" " * 256)
for _b in range(256):
    if ALNUM[_b]:
        _TABLE[_b] = _b + 32 if 65 <= _b <= 90 else _b
_TABLE = bytes(_TABLE)


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, then maximal runs of letters, digits and non-ASCII bytes."""
    return text.translate(_TABLE).split()


class Windows:
    """The distinct windows of a block of items, coded over the items' words (codes from 1)."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.code: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for k, (_, text) in enumerate(items):
            w = np.array([self.code.setdefault(x, len(self.code) + 1) for x in words(text)], np.int32)
            if len(w) >= window:
                rows.append(np.lib.stride_tricks.sliding_window_view(w, window))
            elif len(w):
                rows.append(np.concatenate([np.zeros(window - len(w), np.int32), w])[None, :])
            else:
                continue
            owners.append(np.full(len(rows[-1]), k, np.int64))
        # right-aligned: column -1 is the last word; 0 stands before short ones
        self.symbols, inverse = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.length = (self.symbols > 0).sum(1)
        self.least = int(self.length.min()) if len(self.length) else 0
        pairs = np.unique(np.stack([inverse.ravel(), np.concatenate(owners)], 1), axis=0)
        self._owners, self._at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.length) + 1))

    def items_of(self, which: np.ndarray) -> list[str | None]:
        """The distinct items that have any of the windows, sorted, null first."""
        found = {self.items[k] for x in np.unique(which) for k in self._owners[self._at[x] : self._at[x + 1]]}
        return sorted(found, key=lambda i: (i is not None, i or ""))


class FMIndex:
    """Suffix order, wavelet matrix of the transform, and sampled positions of a coded text; 0 separates runs."""

    def __init__(self, text: np.ndarray, alphabet: int):
        n = self.n = len(text)
        order = self._suffixes(text)
        self.bits = max(1, int(alphabet).bit_length())
        counts = np.bincount(text, minlength=alphabet + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        bwt = text[order - 1]
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (bwt >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        # sampled: every SAMPLE-th position, and those after a separator, which a walk must not cross
        taken = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.sampled = np.where(taken, order, -1)

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """All suffixes in order. Separators differ from each other by position, so no comparison goes past one."""
        n = len(text)
        seps = text == 0
        rank = text + int(seps.sum())
        rank[seps] = np.arange(int(seps.sum()))
        k = 1
        while True:
            follow = np.zeros(n, np.int64)
            follow[: n - k] = rank[k:] + 1
            key = rank * (int(rank.max()) + 2) + follow
            order = np.argsort(key, kind="stable")
            s = key[order]
            fresh = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                return order
            k *= 2

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol among the first i of the transform."""
        lo = np.zeros_like(i)
        for level in range(self.bits):
            ones, bit = self.ones[level], (symbol >> (self.bits - 1 - level)) & 1
            i = np.where(bit == 1, self.zeros[level] + ones[i], i - ones[i])
            lo = np.where(bit == 1, self.zeros[level] + ones[lo], lo - ones[lo])
        return i - lo

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The transform at i, and its rank there."""
        symbol, lo = np.zeros_like(i), np.zeros_like(i)
        for level in range(self.bits):
            ones = self.ones[level]
            bit = ones[i + 1] - ones[i]
            symbol = symbol * 2 + bit
            i = np.where(bit == 1, self.zeros[level] + ones[i], i - ones[i])
            lo = np.where(bit == 1, self.zeros[level] + ones[lo], lo - ones[lo])
        return symbol, i - lo

    def search(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all windows: the suffix range [lo, hi) of each."""
        lo, hi = np.zeros(len(w.length), np.int64), np.full(len(w.length), self.n, np.int64)
        for back in range(1, w.symbols.shape[1] + 1):
            live = np.flatnonzero((w.length >= back) & (lo < hi))
            if len(live) == 0:
                break
            c = w.symbols[live, -back]
            lo[live] = self.before[c] + self.rank(c, lo[live])
            hi[live] = self.before[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps back to the nearest sampled position."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        live = np.arange(len(rows))
        while len(live):
            got = self.sampled[at[live]]
            done = got >= 0
            out[live[done]] = got[done] + steps[live[done]]
            live = live[~done]
            symbol, r = self.symbol_and_rank(at[live])
            at[live] = self.before[symbol] + r
            steps[live] += 1
        return out


class Shard:
    """Coded runs of consecutive texts, until they are indexed; `hits` collects (first word, window) of the occurrences of each row.

    A run of more than SHARD_WORDS words is indexed in parts that overlap by a window less one word, so that no occurrence is cut."""

    def __init__(self, w: Windows):
        self.w, self.hits = w, {}
        self._clear()

    def _clear(self) -> None:
        self.parts: list[np.ndarray] = []
        self.where: list[tuple[int, int]] = []  # per run: row, first word
        self.held = 0

    def add(self, row: int, codes: np.ndarray) -> None:
        stop = np.flatnonzero(np.concatenate([[0], codes, [0]]) == 0)
        runs = np.flatnonzero(np.diff(stop) > self.w.least)
        for a, b in zip(stop[runs].tolist(), (stop[runs + 1] - 1).tolist(), strict=True):
            for x in range(a, b, SHARD_WORDS):
                part = codes[x : min(b, x + SHARD_WORDS + self.w.symbols.shape[1] - 1)]
                if len(part) >= self.w.least:
                    self.parts.append(part)
                    self.where.append((row, x))
                    self.held += len(part) + 1
                    if self.held >= SHARD_WORDS:
                        self.search()

    def search(self) -> None:
        """Index what is held, search all windows, and note their occurrences."""
        if not self.parts:
            return
        sep = np.zeros(1, np.int64)
        index = FMIndex(np.concatenate([sep, *[x for p in self.parts for x in (p, sep)]]), len(self.w.code))
        lo, hi = index.search(self.w)
        n = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(n)), n)
        at = index.locate(np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())))
        begins = np.cumsum([1, *[len(p) + 1 for p in self.parts[:-1]]])
        run = np.searchsorted(begins, at, side="right") - 1
        where = np.array(self.where, np.int64)
        row, first = where[run, 0], where[run, 1] + at - begins[run]
        order = np.argsort(row, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(row[order])) + 1) if len(order) else []:
            self.hits.setdefault(int(row[part[0]]), []).append((first[part], which[part]))
        self._clear()

    def found(self) -> Iterator[tuple[int, np.ndarray, list[str | None]]]:
        """For each row with occurrences: its number, merged spans in words, and items."""
        self.search()
        for row, hits in self.hits.items():
            first, which = (np.concatenate([h[k] for h in hits]) for k in (0, 1))
            yield row, merged(first, self.w.length[which]), self.w.items_of(which)


def merged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Union of word ranges as rows (start, end)."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], np.maximum.accumulate((first + length)[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return np.stack([a[new], b[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])]], 1)


def _scan(w: Windows, carry_text: bool):
    """Map over (row key, text): the key, words, removal spans as word ranges, items, and the text if asked for. Batches are held, without
    their texts unless those are asked for, until they have SHARD_BYTES, and leave as they came."""

    def emit(held: list[pa.RecordBatch], n_words: list[int], shard: Shard) -> Iterator[pa.RecordBatch]:
        spans = {row: (m, items) for row, m, items in shard.found()}
        none, lo = (np.zeros((0, 2), np.int64), []), 0
        held.reverse()
        while held:
            b = held.pop()  # as it came in, so that neither a worker nor the JVM gets a shard's rows as one batch
            every = [spans.get(i, none) for i in range(lo, lo + b.num_rows)]
            at = pa.array(np.concatenate([[0], np.cumsum([len(m) for m, _ in every])]).astype(np.int32))
            flat = np.concatenate([np.zeros((0, 2), np.int64), *[m for m, _ in every]])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(n_words[lo : lo + b.num_rows], pa.int64()),
                    pa.ListArray.from_arrays(at, pa.array(flat[:, 0])),
                    pa.ListArray.from_arrays(at, pa.array(flat[:, 1])),
                    pa.array([items for _, items in every], pa.list_(pa.string())),
                    *([b.column(1)] if carry_text else []),
                ],
                ["__key", "n_words", "span_starts", "span_ends", "items", *(["text"] if carry_text else [])],
            )
            lo += b.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = w.code.get
        held, n_words, shard, size = [], [], Shard(w), 0
        for b in batches:
            raw, off = string_bytes(b.column(1))
            for i in range(b.num_rows):
                ws = words(raw[off[i] : off[i + 1]].tobytes())
                if w.least and len(ws) >= w.least:
                    shard.add(len(n_words), np.fromiter((get(x, 0) for x in ws), np.int64, len(ws)))
                n_words.append(len(ws))
            held.append(b if carry_text else b.select([0]))
            size += held[-1].nbytes + 200 * b.num_rows
            if size >= SHARD_BYTES:
                yield from emit(held, n_words, shard)
                held, n_words, shard, size = [], [], Shard(w), 0
        if held:
            yield from emit(held, n_words, shard)

    return run


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of at most block_bytes (or one item); null texts have no words and are left out. The driver holds one block at a time."""
    block, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").filter("text is not null").toLocalIterator():
        text = r["text"].encode("utf-8", "surrogatepass")
        if block and held + len(text) > block_bytes:
            yield block
            block, held = [], 0
        block.append((r["i"], text))
        held += len(text)
    yield block


def _found_schema(kind: T.DataType, carry_text: bool) -> T.StructType:
    schema = T.StructType([T.StructField("__key", kind)]).add("n_words", T.LongType()).add("span_starts", T.ArrayType(T.LongType())).add("span_ends", T.ArrayType(T.LongType())).add("items", T.ArrayType(T.StringType()))
    return schema.add("text", "string") if carry_text else schema


def _in_blocks(rows: DataFrame, blocks: Iterable[list], window: int, carry_text: bool) -> DataFrame:
    """The rows of _scan() with the hits of all blocks, one for each row of (__key, text)."""
    # written, so that a row has the same number in every pass
    numbered = materialise(rows.withColumn("__n", F.monotonically_increasing_id()), "decontam-rows")
    hits = None
    for items in blocks:
        one = numbered.select(F.col("__n").alias("__key"), "text").mapInArrow(lean(_scan(Windows(items, window), False)), _found_schema(T.LongType(), False))
        one = materialise(one.filter(F.size("span_starts") > 0).drop("n_words"), "decontam-hits")
        hits = one if hits is None else hits.unionByName(one)
    merge = [F.lit(0).cast("long").alias("n_words"), F.array_sort(F.flatten(F.collect_list(F.arrays_zip("span_starts", "span_ends")))).alias("s"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")]
    merged_hits = hits.groupBy("__key").agg(*merge).mapInArrow(lean(_merge_spans), _found_schema(T.LongType(), False)).drop("n_words").withColumnRenamed("__key", "__n")
    words_of = numbered.mapInArrow(lean(_count_words), T.StructType([*numbered.schema.fields]).add("n_words", T.LongType()))
    got = words_of.join(merged_hits, "__n", "left")
    longs = F.array().cast("array<bigint>")
    return got.select("__key", "n_words", F.coalesce("span_starts", longs).alias("span_starts"), F.coalesce("span_ends", longs).alias("span_ends"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), *(["text"] if carry_text else []))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over rows with a text column: the same rows and their numbers of words."""
    for b in batches:
        raw, off = string_bytes(b.column(b.schema.names.index("text")))
        n = [len(words(raw[x:y].tobytes())) for x, y in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], [*b.schema.names, "n_words"])


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = WINDOW, block_bytes: int = 4 << 20, carry_text: bool = False) -> DataFrame:
    """One row per document: the key, n_words, n_hit, removal spans [start, end) in words, and the items that occur.

    With several blocks of a large benchmark the rows are written with a number of their own, and only numbers and spans of rows with hits leave a
    pass; so keys may repeat or be null. key may be a struct of other columns; carry_text keeps the text beside it."""
    kind = docs.schema[key].dataType
    schema = _found_schema(kind, carry_text)
    rows = small_batches(docs).select(F.col(key).alias("__key"), "text")
    blocks = benchmark_blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = rows.mapInArrow(lean(_scan(Windows(first, window), carry_text)), schema)
    else:
        found = _in_blocks(rows, itertools.chain([first, second], blocks), window, carry_text)
    return _judged(found, key, carry_text)


def _judged(found: DataFrame, key: str, carry_text: bool) -> DataFrame:
    """The rows of a scan with the key's own name and n_hit."""
    hit = F.aggregate(F.arrays_zip("span_starts", "span_ends"), F.lit(0).cast("long"), lambda a, x: a + x["span_ends"] - x["span_starts"])
    return found.select(F.col("__key").alias(key), "n_words", hit.alias("n_hit"), "span_starts", "span_ends", "items", *(["text"] if carry_text else []))


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        starts, ends = [], []
        for s in b.column(2).to_pylist():
            a = np.array([x["span_starts"] for x in s], np.int64)
            m = merged(a, np.array([x["span_ends"] for x in s], np.int64) - a) if len(a) else np.zeros((0, 2), np.int64)
            starts.append(m[:, 0].tolist())
            ends.append(m[:, 1].tolist())
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(starts, longs), pa.array(ends, longs), *b.columns[3:]], ["__key", "n_words", "span_starts", "span_ends", *b.schema.names[3:]])


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of contamination(): n_items, items_sha256 and the 5 % rule."""
    return found.select(
        key,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def _excise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over (row, text, span_starts, span_ends): the text without the bytes of the spans' words and what lies between them."""
    for b in batches:
        starts, ends = b.column(2).to_pylist(), b.column(3).to_pylist()
        cut = pa.array([bool(x) for x in starts], pa.bool_())
        if not any(starts):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cut], ["__row", "text", "__cut"])
            continue
        raw, off = string_bytes(b.column(1))
        out = b.column(1).to_pylist()
        for i in range(b.num_rows):
            if starts[i]:
                own = raw[off[i] : off[i + 1]]
                s, e, _ = word_bounds(own, np.array([0, len(own)]), ALNUM)
                keep = np.ones(len(own), bool)
                for x, y in zip(starts[i], ends[i], strict=True):
                    keep[s[x] : e[y - 1]] = False
                out[i] = own[keep].tobytes().decode("utf-8", "surrogatepass")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), cut], ["__row", "text", "__cut"])


def cut_spans(found: DataFrame, row: str, schema: T.StructType, count: str = "n_chars") -> DataFrame:
    """The rows of contamination(key=row, carry_text=True), row a struct of the documents' other columns, with the schema of the documents and removal
    spans cut. Where any was, the number column `count`, if there is one, becomes the new number of code points."""
    out = found.select(F.col(row).alias("__row"), "text", "span_starts", "span_ends").mapInArrow(lean(_excise), _cut_schema(found.schema[row].dataType))
    return _unpacked(out, schema, count)


def _cut_schema(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("__row", kind)]).add("text", "string").add("__cut", "boolean")


def _unpacked(out: DataFrame, schema: T.StructType, count: str) -> DataFrame:
    """Rows of _excise() with the columns of the schema."""

    def column(f: T.StructField):
        if f.name == "text":
            return F.col("text")
        own = F.col("__row").getField(f.name)
        return (F.when(F.col("__cut"), F.char_length("text").cast(f.dataType)).otherwise(own) if f.name == count and isinstance(f.dataType, T.NumericType) else own).alias(f.name)

    return out.select(*[column(f) for f in schema])


def _lightly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over rows of _scan() with texts: those that are not contaminated, as _excise() takes them."""
    for b in batches:
        n_words, at = b.column(1).to_numpy(), b.column(2).offsets.to_numpy()
        before = np.concatenate([[0], np.cumsum(b.column(3).flatten().to_numpy() - b.column(2).flatten().to_numpy())])
        n_hit = before[at[1:]] - before[at[:-1]]
        kept = ~((n_hit > 0) & (20 * n_hit >= n_words))
        rows = pa.RecordBatch.from_arrays([b.column(0), b.column(5), b.column(2), b.column(3)], ["row", "text", "span_starts", "span_ends"])
        yield rows if kept.all() else rows.filter(pa.array(kept))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 4 << 20, count: str = "n_chars") -> DataFrame:
    """The documents that report() does not call contaminated, all columns kept, with the removal spans cut and `count` as in cut_spans().

    With one block of the benchmark, documents are searched, judged and cut by one map, so that a text goes to one Python worker, once."""
    rows = small_batches(docs).select(F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row"), "text")
    blocks = benchmark_blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        scan = _scan(Windows(first, window), True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _excise(_lightly(scan(batches)))

        return _unpacked(rows.mapInArrow(lean(run), _cut_schema(rows.schema["row"].dataType)), docs.schema, count)
    found = _judged(_in_blocks(rows.withColumnRenamed("row", "__key"), itertools.chain([first, second], blocks), window, True), "row", True)
    return cut_spans(found.filter(~((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))), "row", docs.schema, count)
