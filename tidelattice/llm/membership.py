"""A set of hashed ids in a Bloom filter of bounded size: rows outside it need not be shuffled to a join with the ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 29


def filter_bits(rows: int, bits_per_row: int = 16, max_bits: int = MAX_BITS) -> int:
    """A power of two: about bits_per_row for each row, within [2^16, max_bits]."""
    return min(max_bits, 1 << max(16, (max(1, rows) * bits_per_row - 1).bit_length()))


def bitmap(words: DataFrame, bits: int) -> np.ndarray:
    """Rows (w: word number, b: its bits) as an array; at most bits / 64 rows come to the driver."""
    out = np.zeros(bits // 64, np.uint64)
    t = words.select("w", "b").toArrow()
    out[t.column("w").to_numpy()] = t.column("b").to_numpy().view(np.uint64)
    return out


def words_of(positions: DataFrame) -> DataFrame:
    """Positions p as words of 64 bits."""
    return positions.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))


def hashes(column: str) -> list[Column]:
    """Two 64-bit hashes of a column, for the positions."""
    return [F.xxhash64(column).alias("__h1"), F.xxhash64(column, F.lit(1)).alias("__h2")]


def member_filter(ids: DataFrame, column: str, rows: int, max_bits: int = MAX_BITS) -> np.ndarray:
    bits = filter_bits(rows, max_bits=max_bits)
    h1, h2 = hashes(column)
    m = F.lit(bits - 1)
    p = F.explode(F.array(h1.bitwiseAND(m), F.shiftrightunsigned(h1, 32).bitwiseAND(m), h2.bitwiseAND(m)))
    return bitmap(words_of(ids.select(p.alias("p"))), bits)


def maybe_members(table: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """False for hashes() of values that are not in the filter; true for all that are, and few others."""
    m = np.int64(len(table) * 64 - 1)
    out = np.ones(len(h1), bool)
    for p in (h1 & m, (h1.view(np.uint64) >> np.uint64(32)).astype(np.int64) & m, h2 & m):
        out &= (table[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def split(rows: DataFrame, column: str, ids: DataFrame, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """The rows whose `column` may be among the distinct ids (a table of that one column), and those where it is not; null is not.

    Only two hashes a row go to Python. A join of the first part alone leaves the other rows where they are."""
    held = rows.sparkSession.sparkContext.broadcast(member_filter(ids, column, ids.count(), max_bits))

    @F.arrow_udf("boolean")
    def member(h1: pa.Array, h2: pa.Array) -> pa.Array:
        return pa.array(maybe_members(held.value, h1.to_numpy(), h2.to_numpy()))

    found = F.col(column).isNotNull() & member(F.xxhash64(column), F.xxhash64(column, F.lit(1)))
    return rows.filter(found), rows.filter(~found)
