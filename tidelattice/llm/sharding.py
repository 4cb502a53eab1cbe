"""Sharding along a Hilbert curve through metadata space, so that shards are prunable by any of the dimensions.

Dimensions are quantised to 2^BITS steps: size by quantiles, language and source by their order of frequency (the most common get a
step each, the others share the last). Documents are sorted by curve index and cut into runs of equal counts (law `rows`: counts at
most one apart). Equal texts are one group: all take the least curve index of any of them, and within an index rows are ordered by text hash and id,
so that a group lies in one piece and parts only where a cut meets it.

Null text has size 1 and crc32 0; null language and source are values of their own. An empty table gives no rows. Repeated rows have a slot
each; ties, rows alike in index, text and id, are in any order. Texts of any length are carried whole. Other columns may have any name; those named as a new one are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import join_by_size, materialise

BITS = 5
#: Groups of 32 bytes up to which their table is broadcast; the result is the same beyond it.
BROADCAST_GROUPS = 200_000


def hilbert_index(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of points (rows x dimensions, 0 <= value < 2^bits)."""
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the coarsest level on
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _steps(docs: DataFrame, column: str, bits: int):
    """A column's step: 0 for null, then values by frequency; at most 2^bits - 2 values are known by name."""
    top = docs.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit((1 << bits) - 2).collect()
    out = F.when(F.col(column).isNull(), 0)
    for i, r in enumerate(top):
        out = out.when(F.col(column) == r[0], i + 1)
    return out.otherwise((1 << bits) - 1)


def _described(docs: DataFrame, extra: list) -> DataFrame:
    """Rows with the metadata that places them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*extra, "doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__text"))


def _placed(docs: DataFrame, extra: list, shards: int, bits: int) -> DataFrame:
    """The extra columns, doc_id, lang, source, size, text_crc32, curve, shard and slot, in the order of shard and slot."""
    metadata = materialise(_described(docs, []), "shard-metadata")
    cuts = metadata.agg(F.percentile_approx("size", [i / (1 << bits) for i in range(1, 1 << bits)], 10000)).first()[0] or []
    size_step = F.lit(0)
    for c in sorted(set(cuts)):
        size_step = size_step + F.when(F.col("size") > c, 1).otherwise(0)

    @F.arrow_udf("long")
    def curve(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array(hilbert_index(np.stack([x.to_numpy() for x in (a, b, c)], 1), bits))

    index = curve(size_step, _steps(metadata, "lang", bits), _steps(metadata, "source", bits))
    key = ["size", "text_crc32", "__text"]
    # groups of equal texts whose own indexes differ: all rows take the least
    apart = metadata.withColumn("__own", index).groupBy(*key).agg(F.min("__own").alias("__least"), F.max("__own").alias("__most"), F.count("*").alias("__n")).filter("__least != __most")
    apart = materialise(apart.select(*key, "__least", "__n"), "shard-groups")
    own = _described(docs, extra).withColumn("__own", index)
    groups = apart.count()
    if groups <= BROADCAST_GROUPS:
        rows = own.join(F.broadcast(apart), key, "left")
    else:
        rows = join_by_size(own, apart, key, "__n", metadata.count())
    placed = rows.withColumn("curve", F.coalesce("__least", "__own")).drop("__least", "__own", "__n")
    n = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["curve", "size", "text_crc32", "__text", "doc_id"]
    ordered = placed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the written table fixes which rows each sorted partition holds: partition number and place within it
    ordered = materialise(ordered.withColumn("__at", F.monotonically_increasing_id()), "shard-order")
    part = F.shiftright("__at", 33)
    counts = ordered.groupBy(part.alias("p")).count().orderBy("p").collect()  # one row per partition
    total, before = 0, []
    for r in counts:
        before.append((r["p"], total))
        total += r["count"]
    if not total:
        return ordered.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    # an Arrow table: rows of a list would go through Python workers of another kind, whose daemon an executor then keeps beside the others
    offsets = docs.sparkSession.createDataFrame(pa.table({"__p": pa.array([p for p, _ in before], pa.int64()), "__before": pa.array([n for _, n in before], pa.int64())}))
    ranked = ordered.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn("__rank", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1))
    number = F.expr(f"(__rank * {shards}) div {total}L")
    # the least rank of a shard is ceil(shard * total / shards)
    least = F.expr(f"(__shard * {total}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("__shard", number).withColumns({"shard": F.col("__shard").cast("int"), "slot": F.col("__rank") - least})


def shard(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, curve (index), lang, source, shard and slot (from 0 in each shard). No text is moved."""
    return _placed(docs, [], shards, bits).select("doc_id", "size", "text_crc32", "curve", "lang", "source", "shard", "slot")


def place(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """The documents with all their columns, and size, text_crc32, curve, shard and slot. Texts are sorted once; a written file holds a run of the curve."""
    new = ["size", "text_crc32", "curve", "shard", "slot"]
    kept = [c for c in docs.columns if c.lower() not in new]
    placed = _placed(docs, [F.struct(*kept).alias("__row")], shards, bits)
    return placed.select(*[F.col("__row").getField(c).alias(c) for c in kept], *new)
