"""Selecting samples: label matchers, time range and value columns, all as predicates that reach the Parquet scan."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import METRIC, TS, VALUE, MetricTable, QueryError, Vector, present
from ..plans.parser import Matcher

_SPECIAL = re.compile(r"[.+*?^$(){}\[\]\\|]")


def regex(pattern: str) -> str:
    """The pattern without its outer anchors; an inner unescaped $ is an error."""
    p = pattern[1:] if pattern.startswith("^") else pattern
    if p.endswith("$") and not p.endswith("\\$"):
        p = p[:-1]
    if re.search(r"(?<!\\)\$", p):
        raise QueryError(f"$ inside the pattern {pattern!r}")
    return p


def matches(label: Column, op: str, value: str) -> Column | None:
    """The matcher as a predicate; None if it holds for every series. An absent label is the empty string."""
    if op in ("=", "!="):
        if op == "=":
            return label.isNull() | (label == "") if value == "" else label == value
        return label.isNotNull() & (label != "") if value == "" else label.isNull() | (label != value)
    p = regex(value)
    wanted = op == "=~"
    if p == "":
        return matches(label, "=" if wanted else "!=", "")
    if p == ".*":
        return None if wanted else F.lit(False)
    if not _SPECIAL.search(p):
        return matches(label, "=" if wanted else "!=", p)
    parts = p.split("|")
    if not any(_SPECIAL.search(x) for x in parts):
        named = label.isin([x for x in parts if x])
        got = named | label.isNull() | (label == "") if "" in parts else named
        return got if wanted else ~F.coalesce(got, F.lit(False))
    if p.endswith(".*") and not _SPECIAL.search(p[:-2]):
        got = label.startswith(p[:-2])
        return got if wanted else label.isNull() | ~got
    if p == ".+":
        return matches(label, "!=" if wanted else "=", "")
    got = F.coalesce(label, F.lit("")).rlike(f"(?s)\\A(?:{p})\\z")
    return got if wanted else ~got


def holds(label: str | None, op: str, value: str) -> bool:
    """The matcher on a plain string."""
    label = label or ""
    if op in ("=", "!="):
        return (label == value) == (op == "=")
    return bool(re.fullmatch(regex(value), label, re.DOTALL)) == (op == "=~")


def within(values: Iterable[str]):
    """In, as a predicate of a label."""
    listed = list(values)
    return lambda label: F.coalesce(label, F.lit("")).isin(listed)


class FilterMap:
    """Values by label matchers: the first rule all of whose labels are there and match decides. For settings, shard counts, schemas by series."""

    def __init__(self, rules: Iterable[tuple[Iterable[Matcher], str]]):
        self.rules = [(tuple(matchers), value) for matchers, value in rules]

    def get(self, labels: Mapping[str, str]) -> str | None:
        for matchers, value in self.rules:
            if all(m.label in labels and holds(labels[m.label], m.op, m.value) for m in matchers):
                return value
        return None

    def column(self, labels: Iterable[str]) -> Column:
        """The value for every row of a table with these label columns, as one expression."""
        labels, out = set(labels), F.lit(None).cast("string")
        for matchers, value in reversed(self.rules):
            if all(m.label in labels for m in matchers):
                tests = [F.col(m.label).isNotNull() & (F.lit(True) if (t := matches(F.col(m.label), m.op, m.value)) is None else t) for m in matchers]
                out = F.when(reduce(and_, tests, F.lit(True)), F.lit(value)).otherwise(out)
        return out


def filtered(df: DataFrame, labels: Iterable[str], matchers: Iterable[Matcher]) -> DataFrame:
    for m in matchers:
        test = matches(F.col(m.label) if m.label in labels else F.lit(None).cast("string"), m.op, m.value)
        if test is not None:
            df = df.filter(test)
    return df


def epoch_ms(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_millis(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_millis(F.col(column).cast("timestamp"))
    return F.col(column).cast("long")


def between(df: DataFrame, column: str, start: int | None, end: int | None) -> DataFrame:
    """Rows of the time range, compared in the column's own type so that row groups are skipped."""
    kind = df.schema[column].dataType
    for bound, low in ((start, True), (end, False)):
        if bound is None:
            continue
        if isinstance(kind, T.TimestampType | T.TimestampNTZType):
            # a literal of the column's type; a late microsecond of the last millisecond still belongs to it
            at = F.timestamp_millis(F.lit(bound if low else bound + 1)).cast(kind)
            df = df.filter(F.col(column) >= at if low else F.col(column) < at)
        else:
            df = df.filter(F.col(column) >= F.lit(bound) if low else F.col(column) <= F.lit(bound))
    return df


def in_range(table: MetricTable, matchers: Iterable[Matcher], start: int | None, end: int | None) -> DataFrame:
    """The table's rows that match, in the time range; whole days of a partitioned table are skipped by their folder."""
    df = table.df
    if table.day is not None:
        if start is not None:
            df = df.filter(F.col(table.day) >= F.to_date(F.timestamp_millis(F.lit(start))))
        if end is not None:
            df = df.filter(F.col(table.day) <= F.to_date(F.timestamp_millis(F.lit(end))))
    return between(filtered(df, table.labels, matchers), table.time, start, end)


def raw(table: MetricTable, matchers: Iterable[Matcher] = (), start: int | None = None, end: int | None = None, column: str | None = None, extra: Iterable[str] = ()) -> Vector:
    """Samples of a metric: (labels, ts, value), histograms as one row per bucket."""
    from ..model import SCHEMAS

    schema = SCHEMAS[table.schema]
    chosen = schema.column(column or schema.value_column)
    df = in_range(table, matchers, start, end)
    keep = [F.lit(table.name).alias(METRIC), *[F.col(c) for c in table.labels], epoch_ms(df, table.time).alias(TS)]
    keep += [F.col(table.source(c)).cast("double").alias(f"__{c}") for c in extra]
    labels = (METRIC, *table.labels)
    source = F.col(table.source(chosen.name))
    if chosen.kind != "hist":
        return Vector(df.select(*keep, source.cast("double").alias(VALUE)), labels)
    rows = df.select(*keep, source.alias("__h"))
    pairs = F.explode(F.arrays_zip(F.col("__h.les").alias("le"), F.col("__h.counts").alias("count"))).alias("__b")
    names = [c for c in rows.columns if c != "__h"]
    rows = rows.select(*names, pairs).select(*names, F.col("__b.le").alias("__le"), F.col("__b.count").alias(VALUE))
    return Vector(rows, labels, True, chosen.params.get("exp") == "true")


def series(table: MetricTable, matchers: Iterable[Matcher] = (), start: int | None = None, end: int | None = None) -> DataFrame:
    """The series alive in the range: labels, first and last sample time."""
    if table.catalogue is not None:
        parts = filtered(table.catalogue, table.labels, matchers).select(F.lit(table.name).alias(METRIC), *table.labels, "start_ts", "end_ts")
    else:
        df = filtered(table.df, table.labels, matchers)
        at = epoch_ms(df, table.time)
        parts = df.select(F.lit(table.name).alias(METRIC), *table.labels, at.alias("start_ts"), at.alias("end_ts"))
    out = parts.groupBy(METRIC, *table.labels).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    if start is not None:
        out = out.filter(F.col("end_ts") >= start)
    if end is not None:
        out = out.filter(F.col("start_ts") <= end)
    return out


def drop_out_of_order(df: DataFrame, labels: Iterable[str], order: Iterable[str], ts: str = TS, keep_equal: bool = False) -> DataFrame:
    """Keep a sample only if it is later than all of its series that arrived before it."""
    from pyspark.sql import Window

    before = F.max(ts).over(Window.partitionBy(*labels).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    late = F.col(ts) >= F.col("__before") if keep_equal else F.col(ts) > F.col("__before")
    return df.withColumn("__before", before).filter(F.col("__before").isNull() | late).drop("__before")


def no_nan(v: Vector) -> Vector:
    return v.with_df(v.df.withColumn(VALUE, present(F.col(VALUE))).filter(F.col(VALUE).isNotNull()))
