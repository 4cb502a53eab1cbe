"""Binary operators between vectors: equi-joins on label keys and instant, semi and anti joins for set operators.

Which side is broadcast, and how skew is split, is left to adaptive execution, which knows the sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.instant import ARITHMETIC, compare, compared
from ..model import METRIC, TS, VALUE, QueryError, Vector


def key_names(left: Vector, right: Vector, on: tuple[str, ...] | None, ignoring: tuple[str, ...]) -> list[str]:
    if on is not None:
        return list(on)
    skip = {*ignoring, METRIC}
    return [x for x in dict.fromkeys((*left.labels, *right.labels)) if x not in skip]


def keyed(v: Vector, names: list[str]) -> DataFrame:
    """The rows with join keys __k0, __k1, ...; an absent label is the empty string."""
    df = v.df
    for i, n in enumerate(names):
        df = df.withColumn(f"__k{i}", F.coalesce(F.col(n), F.lit("")) if n in v.labels else F.lit(""))
    return df


def _keys(names: list[str]) -> list[str]:
    return [f"__k{i}" for i in range(len(names))]


def unique(df: DataFrame, keys: list[str], side: str, labels: tuple[str, ...] = ()) -> DataFrame:
    """Fail where two series of the side have one key at one instant. Rows of one and the same series (all labels equal) are stitched:
    values that agree are one sample, NaN gives way, and values that differ are no value."""
    each = Window.partitionBy(*keys, TS).orderBy(VALUE)
    all_ = each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    problem = F.raise_error(F.lit(f"several series on the {side} side match one key"))
    series = F.struct(*labels) if labels else F.lit(0)
    known = F.nanvl(VALUE, F.lit(None).cast("double"))
    same = F.col("__n") == 1 if not labels else (F.col("__n") == 1) | F.col("__first").eqNullSafe(F.col("__last"))
    rows = df.withColumns({"__n": F.count("*").over(all_), "__row": F.row_number().over(each), "__low": F.min(known).over(all_), "__high": F.max(known).over(all_)})
    if labels:
        rows = rows.withColumns({"__first": F.min(series).over(all_), "__last": F.max(series).over(all_)})
    one = F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(F.lit(float("nan")).cast("double"))
    checked = rows.filter(F.when(same, F.col("__row") == 1).otherwise(problem.cast("boolean")))
    return checked.withColumn(VALUE, F.when(F.col("__n") == 1, F.col(VALUE)).otherwise(one)).drop("__n", "__row", "__low", "__high", "__first", "__last")


def apply(op: str, a: Column, b: Column, bool_: bool) -> Column:
    return ARITHMETIC[op](a, b) if op in ARITHMETIC else compared(op, a, b) if bool_ else a


def combine(left: Vector, right: Vector, op: str, *, on: tuple[str, ...] | None = None, ignoring: tuple[str, ...] = (), group: str | None = None, include: tuple[str, ...] = (), bool_: bool = False) -> Vector:
    """Arithmetic or comparison. group: the side with several series a key; include: labels taken from the other side."""
    names = key_names(left, right, on, ignoring)
    keys = _keys(names) + (["__le"] if left.histogram and right.histogram else [])
    if left.histogram != right.histogram:
        raise QueryError("a histogram and a plain vector have no operator in common")
    l, r = keyed(left, names), keyed(right, names)
    if group != "left":
        l = unique(l, keys, "left", left.labels)
    if group != "right":
        r = unique(r, keys, "right", right.labels)
    many, one = (right, left) if group == "right" else (left, right)
    if group:
        labels = tuple(dict.fromkeys((*many.labels, *include)))
    elif on is not None:
        labels = tuple(x for x in left.labels if x in on)
    else:
        labels = tuple(x for x in left.labels if x not in ignoring)
    if op in ARITHMETIC:
        labels = tuple(x for x in labels if x != METRIC)
    m, o = (r, l) if group == "right" else (l, r)
    extra = [F.nullif(F.col(x), F.lit("")).alias(f"__i_{x}") if x in one.labels else F.lit(None).cast("string").alias(f"__i_{x}") for x in include]
    joined = m.withColumnRenamed(VALUE, "__many").join(o.select(*keys, TS, F.col(VALUE).alias("__one"), *extra), [*keys, TS])
    a, b = (F.col("__one"), F.col("__many")) if group == "right" else (F.col("__many"), F.col("__one"))
    if op not in ARITHMETIC and not bool_:
        joined = joined.filter(compare(op, a, b))
    columns = [F.col(f"__i_{x}").alias(x) if x in include else F.col(x) for x in labels]
    bucket = ["__le"] if left.histogram else []
    out = joined.select(*columns, *bucket, TS, apply(op, a, b, bool_).cast("double").alias(VALUE))
    result = Vector(out, labels, left.histogram, left.exponential)
    return result.with_df(unique(out, [*result.keys], "result")) if group is None and on is not None or include else result


def with_scalar(v: Vector, op: str, scalar: float | DataFrame, scalar_left: bool, bool_: bool) -> Vector:
    """Pointwise with a number or a (ts, value) frame."""
    if isinstance(scalar, DataFrame):
        df, s = v.df.join(scalar.withColumnRenamed(VALUE, "__s"), TS), F.col("__s")
    else:
        df, s = v.df, F.lit(float(scalar)).cast("double")
    a, b = (s, F.col(VALUE)) if scalar_left else (F.col(VALUE), s)
    if op in ARITHMETIC:
        labels = v.labels
        return Vector(df.select(*v.keys, TS, ARITHMETIC[op](a, b).cast("double").alias(VALUE)), labels, v.histogram, v.exponential)
    if bool_:
        return v.with_df(df.select(*v.keys, TS, compared(op, a, b).alias(VALUE)))
    return v.with_df(df.filter(compare(op, a, b)).select(*v.keys, TS, VALUE))


def align(df: DataFrame, have: tuple[str, ...], labels: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(x) if x in have else F.lit(None).cast("string").alias(x) for x in labels], TS, VALUE)


def set_operation(left: Vector, right: Vector, op: str, on: tuple[str, ...] | None = None, ignoring: tuple[str, ...] = ()) -> Vector:
    """and: instants of left at which some right series of the key has a value. unless: left series whose key no right series has at any
    instant. or: left, and right rows whose key has no left value at the instant."""
    names = key_names(left, right, on, ignoring)
    keys = _keys(names)
    l, r = keyed(left, names), keyed(right, names)
    there = ~F.isnan(VALUE)
    if op == "and":
        return left.with_df(l.join(r.filter(there).select(*keys, TS), [*keys, TS], "left_semi").select(*left.keys, TS, VALUE))
    if op == "unless":
        if not keys:
            l, r, keys = l.withColumn("__k", F.lit(0)), r.withColumn("__k", F.lit(0)), ["__k"]
        return left.with_df(l.join(r.select(*keys), keys, "left_anti").select(*left.keys, TS, VALUE))
    labels = tuple(dict.fromkeys((*left.labels, *right.labels)))
    rest = r.join(l.filter(there).select(*keys, TS), [*keys, TS], "left_anti")
    return Vector(align(left.df, left.labels, labels).unionByName(align(rest, right.labels, labels)), labels)
