"""Connected components: edges are contracted within tasks; the few that are left are joined on the driver, more by alternating
large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import SMALL, lean, materialise

#: Edges contracted at once in a task.
CHUNK = 1 << 20


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of edges, sorted, and the smallest id reachable from each."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while len(x):
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
        # edges between the roots that are left
        x, y = label[x], label[y]
        x, y = x[x != y], y[x != y]
    return ids, ids[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over (u, v): fewer edges with the same components, each id of a chunk with the smallest that the chunk reaches."""

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ids, least = least_reachable(t.column(0).to_numpy(), t.column(1).to_numpy())
        far = ids != least
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(least[far])], ["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            yield chunk(held)
            held, n = [], 0
    if n:
        yield chunk(held)


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """One row (id, component) per linked id, component the smallest id reachable. Loops, repeats and nulls are harmless.

    At most `small` contracted edges are joined on the driver, and the result is marked for broadcast. With more, each step joins
    ids with the least of their neighbours; the steps needed grow with the logarithm of a
    component's size. A hub's rows meet in an inner join, which adaptive execution splits."""
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = materialise(e, "star-edges")
    if e.count() > small:
        e = materialise(e.mapInArrow(lean(_contract), "u long, v long"), "star-0")
        few = e.count() <= small
    else:
        few = True
    if few:
        t = e.toArrow()
        ids, least = least_reachable(t.column(0).to_numpy(), t.column(1).to_numpy())
        return F.broadcast(e.sparkSession.createDataFrame(pa.table({"id": ids, "component": least})))
    seen = None
    for step in range(1, 64):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u != v").distinct()
        e = materialise(small, f"star-{step}")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the stars have not settled after 63 steps")
    found = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
