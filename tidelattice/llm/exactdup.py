"""Exact duplicates by two passes over a Bloom filter: only rows whose digest may repeat are shuffled.

Pass 1 digests every text (white space deleted). The filter is blocked: a digest names one word of 64 bits and up to three bits in it, and
each task combines its digests to the bits of every word set once and those set twice; words are then combined over tasks.
A digest that occurs twice sets all its bits twice, so the bits set at least twice make a filter
without false negatives for repeated digests. Pass 2 sends only rows that this filter accepts through a shuffle;
the others are unique and pass straight through.

The filter has at most `max_bits` bits (64 MB at the default), whatever the input. A digest sets fewer bits when the filter is full, and
with more rows it lets more of them through to the exact grouping, which costs 40 bytes a row; results are the same.

Null text counts as empty, and all such rows are copies of each other. Ties go to the smallest doc_id; a null
doc_id ranks last. Repeated rows count each. An empty table gives an empty result. Texts of any length are digested whole. Only doc_id (of any
type that has an order) and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .membership import MAX_BITS, bitmap, filter_bits
from .store import join_by_size, lean, materialise, small_batches

#: Digests of a task that are combined at once.
COMBINED = 1 << 20


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, sha256 of the text without white space, and code points of the original text."""
    text = F.coalesce("text", F.lit(""))
    bare = F.translate(text, " \t\n\x0b\f\r", "")
    return small_batches(docs).select("doc_id", F.unhex(F.sha2(bare, 256)).alias("__digest"), F.char_length(text).cast("long").alias("__points"))


def _hash() -> Column:
    return F.xxhash64("__digest")


def bits_set(bits: int, rows: int) -> int:
    """Bits that a digest sets: three with ample room, one in a full filter."""
    return 3 if bits >= 6 * rows else 2 if bits >= 3 * rows else 1


def positions(h: np.ndarray, bits: int, k: int) -> np.ndarray:
    """k positions of each hash (rows x k), all in one word of 64 bits."""
    word = (h & np.int64(bits // 64 - 1)) << np.int64(6)
    return np.stack([word | ((h >> np.int64(46 + 6 * i)) & np.int64(63)) for i in range(k)], 1)


def _combine(bits: int, k: int):
    """Map over hashes: for each word the bits that they set, and those that two of them set."""

    def combined(h: np.ndarray) -> pa.RecordBatch:
        p = np.sort(positions(h, bits, k), 1)
        fresh = np.ones(p.shape, bool)
        fresh[:, 1:] = p[:, 1:] != p[:, :-1]  # one hash sets a bit once
        at, n = np.unique(p[fresh], return_counts=True)
        words, first = np.unique(at >> 6, return_index=True)
        bit = np.uint64(1) << (at & 63).astype(np.uint64)
        once = np.bitwise_or.reduceat(bit, first)
        twice = np.bitwise_or.reduceat(np.where(n > 1, bit, np.uint64(0)), first)
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(once.view(np.int64)), pa.array(twice.view(np.int64))], ["w", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy())
            n += b.num_rows
            if n >= COMBINED:
                yield combined(np.concatenate(held))
                held, n = [], 0
        if n:
            yield combined(np.concatenate(held))

    return run


def repeated_filter(digests: DataFrame, bits: int, k: int) -> np.ndarray:
    """The bits that at least two digests set; a word has at most one row of a task's every COMBINED digests, however often one digest occurs."""
    parts = digests.select(_hash().alias("h")).mapInArrow(lean(_combine(bits, k)), "w long, once long, twice long")
    zero = F.struct(F.lit(0).cast("long").alias("o"), F.lit(0).cast("long").alias("t"))
    both = F.aggregate(
        F.collect_list(F.struct("once", "twice")),
        zero,
        lambda a, x: F.struct(a["o"].bitwiseOR(x["once"]).alias("o"), a["t"].bitwiseOR(x["twice"]).bitwiseOR(a["o"].bitwiseAND(x["once"])).alias("t")),
        lambda a: a["t"],
    )
    return bitmap(parts.groupBy("w").agg(both.alias("b")).filter("b != 0"), bits)


def exact_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (lowercase hex)."""
    digests = materialise(digest(docs), "exact-digests")
    rows = digests.count()
    bits = filter_bits(rows, max_bits=max_bits)
    k = bits_set(bits, rows)
    held = docs.sparkSession.sparkContext.broadcast(repeated_filter(digests, bits, k))

    @F.arrow_udf("boolean")
    def accepted(h: pa.Array) -> pa.Array:
        p = positions(h.to_numpy(), bits, k)
        return pa.array(((held.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1).all(1))

    sha = F.lower(F.hex("__digest")).alias("text_sha256")
    alone = digests.filter(~accepted(_hash())).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    maybe = digests.filter(accepted(_hash()))
    # of a group: most code points, then smallest id; nulls last
    rank = F.struct((-F.col("__points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))
    groups = materialise(maybe.groupBy("__digest").agg(F.min(rank).alias("__best"), F.count("*").alias("group_size")), "exact-groups")
    joined = join_by_size(maybe, groups, ["__digest"], "group_size", rows)
    return alone.unionByName(joined.select("doc_id", F.col("__best.c").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("__best.c")).alias("kept"), sha))
