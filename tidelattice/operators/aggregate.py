"""Aggregation across series, per instant and label group: partial and final hash aggregation by Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.range_functions import quantile_bounds
from ..model import TS, VALUE, QueryError, Vector

#: Sums are made of whole 1 / GRID, and of the rests of values under NEAR.
GRID, NEAR = float(1 << 20), float(1 << 32)


def total(v: Column) -> Column:
    """The sum in two parts, so that it does not hang on the order of the rows: whole 1 / GRID, which add up exactly below 2^33, and rests, too small
    for their rounding to show. Values from NEAR on, infinite ones too, are added as they are."""
    whole = F.when(F.abs(v) < NEAR, F.rint(v * GRID) / GRID).otherwise(v)
    return F.sum(whole) + F.sum(F.when(F.abs(v) < NEAR, v - whole).otherwise(F.lit(0.0)))


SIMPLE = {
    "sum": total,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": lambda v: F.count(v).cast("double"),
    "group": lambda v: F.max(F.lit(1.0)),
    "stddev": F.stddev_pop,
    "stdvar": F.var_pop,
}
ON_HISTOGRAMS = ("sum", "count")


def grouping(v: Vector, by: tuple[str, ...] | None, without: tuple[str, ...] | None) -> tuple[str, ...]:
    """Labels of a group: those listed, all but those listed, or none."""
    if by is not None:
        return tuple(x for x in v.labels if x in by)
    if without is not None:
        return tuple(x for x in v.labels if x not in without)
    return ()


def double_text(v: Column) -> Column:
    """A double as Java writes it: 1.0, 2.5, 1.0E10."""
    return v.cast("string")


def aggregate(v: Vector, op: str, by: tuple[str, ...] | None = None, without: tuple[str, ...] | None = None, param: float | str | None = None, limit: int = 1000) -> Vector:
    keys = grouping(v, by, without)
    if v.histogram:
        if op not in ON_HISTOGRAMS:
            raise QueryError(f"{op} is not defined for histograms")
        if op == "count":  # histograms, not buckets
            top = v.df.groupBy(*v.labels, TS).agg(F.max(VALUE).alias(VALUE))
            return Vector(top.groupBy(*keys, TS).agg(F.count(VALUE).cast("double").alias(VALUE)), keys)
        more = [(F.max if c == "__max" else F.min)(c).alias(c) for c in v.extremes]
        return Vector(monotonic(v.df.groupBy(*keys, "__le", TS).agg(F.sum(VALUE).alias(VALUE), *more), keys), keys, True, v.exponential)
    df = v.df.filter(F.col(VALUE).isNotNull() & ~F.isnan(VALUE))
    if op in SIMPLE:
        return Vector(df.groupBy(*keys, TS).agg(SIMPLE[op](F.col(VALUE)).alias(VALUE)), keys)
    if op in ("topk", "bottomk"):
        value = F.desc(VALUE) if op == "topk" else F.asc(VALUE)
        rank = F.row_number().over(Window.partitionBy(*keys, TS).orderBy(value, *v.labels))
        return v.with_df(df.withColumn("__k", rank).filter(F.col("__k") <= int(param)).drop("__k"))
    if op == "quantile":
        q = float(param)
        inside = F.percentile(VALUE, min(1.0, max(0.0, q)))
        out = df.groupBy(*keys, TS).agg(inside.alias("__q"))
        return Vector(out.select(*keys, TS, quantile_bounds(q, F.col("__q")).alias(VALUE)), keys)
    if op == "count_values":
        name = str(param)
        kept = tuple(k for k in keys if k != name)
        counted = df.select(*kept, TS, double_text(F.col(VALUE)).alias(name)).groupBy(*kept, name, TS).agg(F.count("*").cast("double").alias(VALUE))
        distinct = F.count("*").over(Window.partitionBy(*kept, TS))
        checked = F.when(F.col("__n") <= limit, F.col(VALUE)).otherwise(F.raise_error(F.lit(f"count_values found more than {limit} distinct values")))
        return Vector(counted.withColumn("__n", distinct).select(*kept, name, TS, checked.cast("double").alias(VALUE)), (*kept, name))
    raise QueryError(f"no aggregator {op}")


def monotonic(df, keys: tuple[str, ...]):
    """Bucket counts made non-decreasing along the bounds."""
    upto = F.max(VALUE).over(Window.partitionBy(*keys, TS).orderBy("__le").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(VALUE, upto)
