"""Near duplicates by an LSH forest of minhash signatures, confirmed on whole shingle sets.

1. Every document's distinct word shingles are hashed; documents with one and the same set are one class from here on.
2. Each class has TREES signature sequences of DEPTH minhashes. For every tree the classes are put into the
   order of that sequence (range partitioning and sorting, the id as last key, so that no prefix is too common to be
   split), and a longest common prefix of LEAST minhashes makes two classes candidates of a region.
3. The depth adapts to the region: a run with a common prefix is compared pair by pair if it has at most REGION
   rows, by b-bit sketches inside the task; a larger one is cut at its next minhash, and what is
   still larger at full depth is cut into runs of REGION rows by its order. Regions that were cut in this way, or by the edge
   of a chunk or a partition, are open: their members are listed as well.
4. A region with few pairs of agreeing sketches emits them. In a dense one their number would grow with its square: there all
   pairs are compared exactly, on full sets, inside one bounded task, and a spanning forest of the true links is emitted. One with
   more shingles than two slices is open instead.
5. Of the emitted pairs, the best for each class are confirmed on full sets and joined to components; the others are
   confirmed afterwards where they would still connect two components (all of them, without a cap).
6. Open regions that share members are one family. In a family all pairs in different components are compared exactly, on full
   sets: it is dealt into slices, and each pair of slices is a task of its own; only slices of its most common component
   are not compared with each other, as their members are linked already.
A pair of similarity 0.8 misses all trees with probability (1 - 0.8 ** LEAST) ** TREES = 3e-6, and the sketches of a region that is not
open with probability 4.3e-5 (fewer than `need` of SKETCH places agree).

Null and empty texts have no set, belong to no class and are linked with nothing. Texts shorter than a shingle are one
shingle. Rows with a null doc_id are returned unlinked. Rows that repeat a doc_id are one document: each has the size of its own set, and all share
a component, which any of their texts may link. An empty table gives an empty result. Only doc_id (of an integer type) and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from .graph import components
from .membership import hashes, maybe_members, member_filter
from .store import if_small, join_by_size, lean, materialise, small_batches
from .text import LOWER, NOT_SPACE, blocks, shingle_hashes, span_hashes, string_bytes, word_bounds

TREES, DEPTH, LEAST, REGION = 24, 8, 4, 1024
SKETCH = 64
#: Rows sorted and compared together in a task.
CHUNK = 1 << 17
#: Sets of a slice of a family, and their shingles together, on average.
SLICE, SLICE_SHINGLES = 512, 1 << 20

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, off = string_bytes(column)
    for i, j in blocks(off):
        own = LOWER[raw[off[i] : off[j]]]
        starts, ends, first = word_bounds(own, off[i : j + 1] - off[i], NOT_SPACE)
        h, at = shingle_hashes(span_hashes(own, starts, ends), first, k)
        for d in range(j - i):
            x = np.sort(h[at[d] : at[d + 1]])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minhashes (sets x TREES*DEPTH, uint32) of non-empty sets."""
    out = np.empty((len(sets), TREES * DEPTH), np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= 1 << 15):
            n += len(sets[j])
            j += 1
        x = (np.concatenate(sets[i:j]) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[i : j - 1]])]).astype(np.int64)
        buf = np.empty_like(x)
        for f in range(TREES * DEPTH):
            np.multiply(x, _A[f], out=buf)
            np.add(buf, _B[f], out=buf)
            out[i:j, f] = np.minimum.reduceat(buf, at)
        i = j
    return out


def _describe(k: int):
    """Map over (doc_id, text): set size, digest of the set, and its minhashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                sets = list(shingle_sets(part.column(1), k))
                sig = iter(signatures([s for s in sets if len(s)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "__set", "__sig"],
                )

    return run


_MEMBER = "tree int, key binary, sketch binary, n int, id long"


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over (id, n_shingles, __sig): one row per tree, its key the tree's minhashes in byte order."""
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            part = b.slice(lo, 2000)
            sig = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint32).reshape(-1, TREES * DEPTH)
            n = len(sig)
            # 16 bits of each: mixed, as a minimum's high bits are mostly 0
            short = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")
            sketch = (short.astype(np.uint16)[:, :: TREES * DEPTH // SKETCH] & 0xFF).astype(np.uint8)
            sketches = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH), n, [None, pa.py_buffer(np.ascontiguousarray(sketch))]).cast(pa.binary())
            ids, size = part.column(0), part.column(1).cast(pa.int32())
            for t in range(TREES):
                key = np.ascontiguousarray(short[:, t * DEPTH : (t + 1) * DEPTH])
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * DEPTH), n, [None, pa.py_buffer(key)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), keys, sketches, size, ids], ["tree", "key", "sketch", "n", "id"])


def _regions(key: np.ndarray, lo: int, hi: int, depth: int) -> Iterator[tuple[int, int]]:
    """Runs of sorted rows to compare: common prefixes of `depth`, deeper where larger than REGION."""
    todo = [(lo, hi, depth)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo <= REGION:
            if hi - lo > 1:
                yield lo, hi
        elif depth == DEPTH:
            todo.extend((x, min(x + REGION, hi), depth) for x in range(lo, hi, REGION))
        else:
            cut = np.flatnonzero(key[lo + 1 : hi, depth] != key[lo : hi - 1, depth]) + 1 + lo
            edges = [lo, *cut.tolist(), hi]
            todo.extend((x, y, depth + 1) for x, y in zip(edges[:-1], edges[1:], strict=True) if y - x > 1)


def _pairs_of(sketch: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i < j) of a region whose sketches agree in at least `need` places, and how many agree."""
    n = len(sketch)
    a, b, s = [], [], []
    step = max(1, (1 << 22) // (n * SKETCH))
    for i in range(0, n, step):
        same = (sketch[i : i + step, None, :] == sketch[None, i:, :]).sum(2, dtype=np.uint8)
        x, y = np.nonzero(same >= need)
        keep = y > x
        a.append(x[keep] + i)
        b.append(y[keep] + i)
        s.append(same[x[keep], y[keep]])
    return np.concatenate(a), np.concatenate(b), np.concatenate(s)


def _compare(need: int):
    """Map over sorted members: candidate pairs (a, b, agree), the members of dense regions as (region, id, -1), and those of open ones as (region, id, -2 - size of the set).

    A dense region with more shingles than two slices is none for one task, and is an open one."""

    def name(x: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big", signed=True)

    def chunk(rows: pa.Table, region: int) -> tuple[pa.RecordBatch, int]:
        n = rows.num_rows
        tree = rows.column(0).to_numpy()
        key = np.frombuffer(b"".join(rows.column(1).to_pylist()), ">u2").reshape(n, DEPTH)
        sketch = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint8).reshape(n, SKETCH)
        sizes, ids = rows.column(3).to_numpy(), rows.column(4).to_numpy()
        same = (tree[1:] == tree[:-1]) & (key[1:, :LEAST] == key[:-1, :LEAST]).all(1)
        cut = np.flatnonzero(~same) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [n]])
        none = np.zeros(0, np.int64)
        a, b, s = [none], [none], [none]
        end = np.zeros(n, np.int64)
        small = (hi - lo <= 16) & (hi - lo > 1)
        for x, y in zip(lo[small], hi[small], strict=True):
            end[x:y] = y
        for o in range(1, 16):
            i = np.flatnonzero(end > np.arange(n) + o)
            if len(i) == 0:
                break
            agree = (sketch[i] == sketch[i + o]).sum(1)
            ok = agree >= need
            a.append(np.minimum(ids[i[ok]], ids[i[ok] + o]))
            b.append(np.maximum(ids[i[ok]], ids[i[ok] + o]))
            s.append(agree[ok])
        for x, y in zip(lo[hi - lo > 16], hi[hi - lo > 16], strict=True):
            for p, q in _regions(key, int(x), int(y), LEAST):
                i, j, agree = _pairs_of(sketch[p:q], need)
                if len(i) <= DENSE * (q - p):
                    a.append(np.minimum(ids[i + p], ids[j + p]))
                    b.append(np.maximum(ids[i + p], ids[j + p]))
                    s.append(agree)
                else:
                    inside = np.unique(np.concatenate([i, j])) + p
                    heavy = sizes[inside].sum(dtype=np.int64) > 2 * SLICE_SHINGLES
                    a.append(np.full(len(inside), name(b"dense %d" % region) if heavy else region))
                    b.append(ids[inside])
                    s.append(-2 - sizes[inside] if heavy else np.full(len(inside), -1))
                    region += 1
        large = hi - lo > REGION
        large[[0, -1]] = True  # may go on in the chunk before or after
        for x, y in zip(lo[large], hi[large], strict=True):
            a.append(np.full(y - x, name(b"%d " % tree[x] + key[x, :LEAST].tobytes())))
            b.append(ids[x:y])
            s.append(-2 - sizes[x:y])
        columns = [np.concatenate(a), np.concatenate(b), np.concatenate(s).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "agree"]), region

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        region = TaskContext.get().partitionId() << 33
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                out, region = chunk(pa.Table.from_batches(held), region)
                yield out
                held, n = [], 0
        if n:
            yield chunk(pa.Table.from_batches(held), region)[0]

    return run


#: Pairs per row of a region up to which its pairs are emitted.
DENSE = 16
#: Shingles of a dense region that are counted at once.
COLUMNS = 4096


def exact_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (100 * intersection >= percent * union) between sets, all pairs compared."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        x, y = np.searchsorted(column, (lo, lo + COLUMNS))
        m = np.zeros((n, COLUMNS), np.float32)
        m[row[x:y], column[x:y] - lo] = 1
        both += m @ m.T
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(linked, False)
    a, b, left = [], [], np.ones(n, bool)
    while left.any():
        todo = [int(np.argmax(left))]
        left[todo[0]] = False
        while todo:
            x = todo.pop()
            near = np.flatnonzero(linked[x] & left)
            left[near] = False
            a += [ids[x]] * len(near)
            b += ids[near].tolist()
            todo += near.tolist()
    return np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)


def _dense(percent: int):
    """One region of (region, id, s): its links."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("id").to_numpy()
        a, b = exact_links(ids, [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("s")], percent)
        return pa.table({"a": a, "b": b})

    return run


def _sets(k: int, held):
    """Map over (id, text, __h1, __h2): the shingle sets of texts whose id the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(maybe_members(held.value, b.column(2).to_numpy(), b.column(3).to_numpy())))
            sets = [s.tobytes() for s in shingle_sets(b.column(1), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary()), pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary())], ["id", "s", "__set"])

    return run


def _confirm(percent: int):
    """Map over (a, b, s_a, s_b): the pairs with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[r].as_buffer(), np.uint64) for c in (2, 3))
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    small, large = (x, y) if len(x) <= len(y) else (y, x)
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    both = int(np.count_nonzero(large[at] == small))
                    keep[r] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("s_a")), "a")
    return with_a.join(sets.select(F.col("id").alias("b"), F.col("s").alias("s_b")), "b").select("a", "b", "s_a", "s_b").mapInArrow(lean(_confirm(percent)), "a long, b long")


def _across(open_: DataFrame, joined: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links of the pairs of each family of open regions (region, id, n) that are in different components; None if there is no such pair."""
    marked = open_.join(joined, "id", "left").select("region", "id", "n", F.coalesce("component", "id").alias("c"))
    # a region whose members are linked already needs nothing
    mixed = marked.groupBy("region").agg(F.min("c").alias("__lo"), F.max("c").alias("__hi"), F.min("id").alias("hub")).filter("__lo != __hi").select("region", "hub")
    mixed = materialise(mixed, "near-mixed")
    if mixed.isEmpty():
        return None
    marked = materialise(marked.join(if_small(mixed), "region"), "near-open")
    family = components(marked.select("id", "hub"), "id", "hub").withColumnRenamed("component", "family")
    rows = materialise(marked.select("id", "n", "c").distinct().join(family, "id"), "near-families")
    by = rows.groupBy("family", "c").agg(F.count("*").alias("n"), F.sum(8 * F.col("n").cast("long")).alias("__b"))
    total = by.groupBy("family").agg(F.max(F.struct("n", "c", "__b")).alias("top"), F.sum("n").alias("n"), F.sum("__b").alias("__b"))
    slices = lambda n, b: F.ceil(F.greatest(n / SLICE, b / (8 * SLICE_SHINGLES))).cast("int")
    # slices 0 .. others - 1 hold the members outside the most common component, the next ones its own
    total = total.select("family", F.col("top.c").alias("__top"), slices(F.col("n") - F.col("top.n"), F.col("__b") - F.col("top.__b")).alias("others"), slices(F.col("top.n"), F.col("top.__b")).alias("own"))
    total = if_small(materialise(total, "near-slices"))
    rows = rows.select("id", "c", "family").join(total, "family").withColumn("__is", F.col("c") == F.col("__top"))
    at = F.pmod(F.xxhash64("id"), F.when(F.col("__is"), F.col("own")).otherwise(F.col("others")).cast("long")).cast("int")
    rows = rows.withColumn("x", at + F.when(F.col("__is"), F.col("others")).otherwise(0))
    meets = F.when(F.col("__is"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("own") - 1))
    placed = rows.select("family", "id", "x", F.explode(meets).alias("y")).select("family", "id", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    return placed.join(sets, "id").groupBy("family", "i", "j").applyInArrow(_dense(percent), "a long, b long")


def _same_document(described: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that repeat a doc_id with different sets."""
    rows = described.filter("__set is not null and doc_id is not null").select("doc_id", "__set")
    several = rows.groupBy("doc_id").agg(F.min("__set").alias("x"), F.max("__set").alias("y")).filter("x != y").select("doc_id")
    named = materialise(rows.join(several, "doc_id", "left_semi").distinct().join(classes.select("__set", "id"), "__set").select("doc_id", "id"), "near-repeated")
    return named.join(named.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).filter("a != b")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, best: int = 2) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (its representative)."""
    spark = small_batches(docs).sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be of an integer type")
    described = materialise(docs.select("doc_id", "text").mapInArrow(lean(_describe(shingle)), "doc_id long, n_shingles long, __set binary, __sig binary"), "near-described")
    rows = described.count()
    # a class per distinct set, named by its smallest id
    classes = materialise(described.filter("__set is not null and doc_id is not null").groupBy("__set").agg(F.min("doc_id").alias("id"), F.count("*").alias("__n"), F.first("n_shingles").alias("n_shingles"), F.first("__sig").alias("__sig")), "near-classes")
    members = classes.select("id", "n_shingles", "__sig").mapInArrow(lean(_plant), _MEMBER)
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = members.repartitionByRange(n, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    # 0.8 less four standard deviations of a sketch's agreement
    need = int(SKETCH * (percent / 100 - 4 * ((percent / 100) * (1 - percent / 100) / SKETCH) ** 0.5))
    found = ordered.mapInArrow(lean(_compare(need)), "a long, b long, agree int")
    found = materialise(found, "near-found")
    members = found.filter("agree = -1").select(F.col("a").alias("region"), F.col("b").alias("id"))
    marked = found.filter("agree <= -2").select(F.col("a").alias("region"), F.col("b").alias("id"), (-2 - F.col("agree")).alias("n"))
    ids = found.select(F.explode(F.when(F.col("agree") >= 0, F.array("a", "b")).otherwise(F.array("b"))).alias("id")).distinct()
    # several rows may repeat an id: the class's own text is one whose set is the class's
    wanted = materialise(classes.select("id", "__set").join(ids, "id"), "near-wanted")
    held = spark.sparkContext.broadcast(member_filter(wanted, "id", wanted.count()))
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text").select("id", "text", *hashes("id"))
    # only sets that may be wanted leave their task; a repeated id may have several
    sets = texts.mapInArrow(lean(_sets(shingle, held)), "id long, s binary, __set binary").join(wanted, ["id", "__set"], "left_semi").dropDuplicates(["id", "__set"]).drop("__set")
    sets = materialise(sets, "near-sets")
    dense = members.join(sets, "id").groupBy("region").applyInArrow(_dense(percent), "a long, b long")
    pairs = found.filter("agree >= 0").groupBy("a", "b").agg(F.max("agree").alias("agree"))
    by = lambda c: Window.partitionBy(c).orderBy(F.desc("agree"), "a", "b")
    ranked = pairs.withColumn("ra", F.row_number().over(by("a"))).withColumn("rb", F.row_number().over(by("b")))
    ranked = materialise(ranked.select("a", "b", ((F.col("ra") <= best) | (F.col("rb") <= best)).alias("first")), "near-ranked")
    joined = components(dense.unionByName(_confirmed(ranked.filter("first").select("a", "b"), sets, percent)).unionByName(_same_document(described, classes)))
    linked = joined.select(F.col("id").alias("a"), F.col("component").alias("b"))
    at = lambda c: joined.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    rest = ranked.filter("not first").join(at("a"), "a", "left").join(at("b"), "b", "left").filter("coalesce(ca, a) != coalesce(cb, b)").select("a", "b")
    rest = materialise(rest, "near-rest")
    if not rest.isEmpty():
        joined = components(linked.unionByName(_confirmed(rest, sets, percent)))
        linked = joined.select(F.col("id").alias("a"), F.col("component").alias("b"))
    across = _across(marked, joined, sets, percent)
    if across is not None:
        joined = components(linked.unionByName(across))
    component = classes.join(joined, "id", "left").select("__set", "__n", F.coalesce("component", "id").alias("component_id"))
    alone = described.filter("__set is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = join_by_size(described.filter("__set is not null and doc_id is not null").select("doc_id", "n_shingles", "__set"), component, ["__set"], "__n", rows)
    out = alone.unionByName(linked.select("doc_id", "n_shingles", "component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
