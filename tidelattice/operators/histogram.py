"""Functions of histograms, as expressions over the sorted bucket array of each (series, instant).

A histogram vector has a row per bucket; le-series (a label `le`) take the same path. Bucket values are cumulative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import INF, LE, METRIC, NAN, TS, VALUE, QueryError, Vector, double
from ..functions.instant import divide


def le_text(le: Column) -> Column:
    """A bound as a label: +Inf, and whole numbers without a fraction."""
    return F.when(le == INF, F.lit("+Inf")).when(le == F.floor(F.when(F.abs(le) < 1e15, le)), F.floor(F.when(F.abs(le) < 1e15, le)).cast("string")).otherwise(le.cast("string"))


def le_value(label: Column) -> Column:
    """The label le as a bound; null if it is none."""
    return F.when(F.lower(label).isin("+inf", "inf"), double(INF)).otherwise(F.expr("try_cast(le as double)"))


def buckets(v: Vector) -> tuple[DataFrame, tuple[str, ...]]:
    """(labels, ts, b) with b the array of (le, v) by bound, values made non-decreasing."""
    if v.histogram:
        df, labels = v.df, v.labels
    elif LE in v.labels:
        df, labels = v.df.withColumn("__le", le_value(F.col(LE))).filter(F.col("__le").isNotNull()), tuple(x for x in v.labels if x != LE)
    else:
        raise QueryError("a histogram function needs a histogram or an le label")
    pair = F.struct(F.col("__le").alias("le"), F.coalesce(F.nanvl(VALUE, F.lit(None).cast("double")), double(-INF)).alias("v"))
    more = [(F.max if c == "__max" else F.min)(c).alias(c) for c in v.extremes]
    grouped = df.groupBy(*labels, TS).agg(F.array_sort(F.collect_list(pair)).alias("b"), *more)
    return grouped.withColumn("b", rising(F.col("b"))), labels


def rising(b: Column) -> Column:
    start = F.struct(double(0.0).alias("m"), F.expr("cast(array() as array<struct<le:double,v:double>>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        m = F.greatest(s["m"], x["v"])
        return F.struct(m.alias("m"), F.concat(s["out"], F.array(F.struct(x["le"].alias("le"), m.alias("v")))).alias("out"))

    # counts mostly rise already; only the others pay for a copy of the array at each bucket
    counts = F.transform(b, lambda x: x["v"])
    return F.when(F.array_sort(counts) == counts, b).otherwise(F.aggregate(b, start, step)["out"])


def quantile_of(b: Column, q: Column, exponential: bool = False, top_bound: Column | None = None, need_inf: bool = False, even: bool = False) -> Column:
    """The q-quantile of a bucket array. top_bound is the upper bound in the bucket that holds it; even spreads a bucket's samples evenly inside it."""
    n = F.size(b)
    total = F.get(b, n - 1)["v"]
    rank = q * total
    at = F.array_position(F.transform(b, lambda x: x["v"] >= rank), True).cast("int") - 1
    at = F.when(at < 0, n - 1).otherwise(at)
    hi, lo = F.get(b, at)["le"], F.when(at > 0, F.get(b, at - 1)["le"]).otherwise(0.0)
    if top_bound is not None:
        hi = F.when((top_bound > lo) & (top_bound <= hi), top_bound).otherwise(hi)
    low_count = F.when(at > 0, F.get(b, at - 1)["v"]).otherwise(0.0)
    inside = F.get(b, at)["v"] - low_count
    share = (rank - low_count) / (inside + 1) if even else F.when(inside > 0, (rank - low_count) / F.when(inside > 0, inside)).otherwise(0.0)
    linear = lo + (hi - lo) * share
    if exponential:
        positive = (lo > 0) & (hi > 0)
        linear = F.when(positive, F.pow(F.lit(2.0), F.log2(F.when(positive, lo)) + (F.log2(F.when(positive, hi)) - F.log2(F.when(positive, lo))) * share)).otherwise(linear)
    found = F.when((at == n - 1) & (hi == INF), F.get(b, n - 2)["le"]).when((at == 0) & (hi <= 0), hi).otherwise(linear)
    ok = (n >= 2) & (total > 0)
    if need_inf:
        ok = ok & (F.get(b, n - 1)["le"] == INF)
    return F.when(~ok | F.isnan(q), double(NAN)).when(q < 0, double(-INF)).when(q > 1, double(INF)).otherwise(found)


def _result(df: DataFrame, labels: tuple[str, ...], value: Column) -> Vector:
    return Vector(df.select(*labels, TS, value.cast("double").alias(VALUE)).filter(~F.isnan(VALUE)), labels)


def histogram_quantile(q: float, v: Vector) -> Vector:
    df, labels = buckets(v)
    return _result(df, labels, quantile_of(F.col("b"), double(q), v.exponential, need_inf=not v.histogram))


def histogram_max_quantile(q: float, v: Vector, even: bool = False) -> Vector:
    """The largest observation of each histogram, read with it, bounds the bucket it lies in."""
    if "__max" not in v.extremes:
        raise QueryError("this quantile needs histograms with a column max")
    df, labels = buckets(v)
    df = df.filter(F.col("__max").isNotNull())
    return _result(df, labels, quantile_of(F.col("b"), double(q), v.exponential, F.col("__max"), even=even))


def count_below(b: Column, x: float, exponential: bool = False) -> Column:
    """Observations up to x, linear inside its bucket, or linear in log2 for exponential buckets but the first."""
    if x == INF:
        return F.get(b, F.size(b) - 1)["v"]
    at = F.array_position(F.transform(b, lambda y: y["le"] >= x), True).cast("int") - 1
    lo, low = F.when(at > 0, F.get(b, at - 1)["le"]).otherwise(0.0), F.when(at > 0, F.get(b, at - 1)["v"]).otherwise(0.0)
    hi, high = F.get(b, at)["le"], F.get(b, at)["v"]
    width = hi - lo
    share = (F.lit(float(x)) - lo) / F.when(width > 0, width)
    if exponential and x > 0:
        log = lambda c: F.log2(F.when(c > 0, c))
        share = F.when((at > 0) & (lo > 0), (log(F.lit(float(x))) - log(lo)) / F.when(log(hi) > log(lo), log(hi) - log(lo))).otherwise(share)
    inside = F.when(hi == INF, F.when(F.lit(float(x)) == INF, high).otherwise(low)).when(width > 0, low + (high - low) * share).otherwise(high)
    return F.when(at < 0, F.get(b, F.size(b) - 1)["v"]).otherwise(inside)


def histogram_fraction(lower: float, upper: float, v: Vector) -> Vector:
    """Share of observations between two bounds of at least 0; (0, 0) is the first bucket's share."""
    if lower < 0 or upper < 0:
        raise QueryError("bounds of a fraction are not negative")
    df, labels = buckets(v)
    b = F.col("b")
    total = F.get(b, F.size(b) - 1)["v"]
    if lower == upper == 0:
        part = F.get(b, F.lit(0))["v"]
    elif lower >= upper:
        part = F.lit(0.0)
    else:
        part = count_below(b, upper, v.exponential) - (count_below(b, lower, v.exponential) if lower > 0 else F.lit(0.0))
    return _result(df, labels, F.when(total > 0, divide(part, total)).otherwise(double(NAN)))


def histogram_bucket(le: float, v: Vector) -> Vector:
    """The bucket with that very bound, as a plain vector."""
    if not v.histogram:
        raise QueryError("histogram_bucket needs a histogram")
    same = F.col("__le") == INF if le == INF else F.abs(F.col("__le") - le) <= 1e-10
    return Vector(v.df.filter(same).select(*v.labels, TS, VALUE), v.labels)


def to_le_series(v: Vector) -> Vector:
    """One series per bucket: the metric with _bucket, and its bound as label le."""
    if not v.histogram:
        raise QueryError("a histogram is needed")
    df = v.df.withColumn(LE, le_text(F.col("__le")))
    if METRIC in v.labels:
        df = df.withColumn(METRIC, F.concat(METRIC, F.lit("_bucket")))
    labels = (*v.labels, LE)
    return Vector(df.select(*labels, TS, VALUE), labels)


def collect(v: Vector) -> DataFrame:
    """(labels, ts, les, counts), and max and min if they were read: histograms as arrays again."""
    df, labels = buckets(v)
    return df.select(*labels, TS, F.transform("b", lambda x: x["le"]).alias("les"), F.transform("b", lambda x: x["v"]).alias("counts"), *[F.col(c).alias(c[2:]) for c in v.extremes])
