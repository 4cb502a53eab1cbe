"""Metadata and cardinality: questions about series, answered from one aggregation of the samples by label columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import METRIC, LimitError, MetricTable, QueryError
from ..plans.parser import Matcher
from .select import series


def label_values(table: MetricTable, names: Iterable[str], matchers: tuple[Matcher, ...] = (), start: int | None = None, end: int | None = None) -> DataFrame:
    """Distinct values (combinations, for several labels) among series alive in the range."""
    names = list(names)
    if len(names) > 1 and not matchers:
        raise QueryError("several labels need a filter")
    found = series(table, matchers, start, end)
    known = [F.col(n) if n in found.columns else F.lit(None).cast("string").alias(n) for n in names]
    return found.select(*known).dropna(how="all").distinct()


def label_names(table: MetricTable, matchers: tuple[Matcher, ...] = (), start: int | None = None, end: int | None = None) -> DataFrame:
    """Labels that some series alive in the range has."""
    found = series(table, matchers, start, end)
    names = [METRIC, *table.labels]
    counted = found.agg(*[F.count(n).alias(n) for n in names])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("n")) for n in names])).alias("x")).filter("x.n > 0").select("x.label")


def series_keys(table: MetricTable, matchers: tuple[Matcher, ...] = (), start: int | None = None, end: int | None = None, times: bool = False) -> DataFrame:
    found = series(table, matchers, start, end)
    return found if times else found.drop("start_ts", "end_ts")


def label_cardinality(table: MetricTable, matchers: tuple[Matcher, ...] = (), start: int | None = None, end: int | None = None, exact: bool = False) -> DataFrame:
    """label -> number of distinct values, by a sketch unless exact."""
    count = F.countDistinct if exact else F.approx_count_distinct
    found = series(table, matchers, start, end)
    names = [METRIC, *table.labels]
    counted = found.agg(*[count(n).alias(n) for n in names])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("distinct_values")) for n in names])).alias("x")).select("x.*")


def cardinalities(table: MetricTable, by: Iterable[str], now: int, active_ms: int = 3_600_000, short_ms: int = 7 * 86_400_000, matchers: tuple[Matcher, ...] = (), top: int | None = None) -> DataFrame:
    """Per group of up to three labels: series active now, seen in the short term and at all. With `top`, further groups share one row."""
    by = list(by)
    if not 1 <= len(by) <= 3:
        raise QueryError("cardinalities group by one to three labels")
    found = series(table, matchers)
    counts = [F.count_if(F.col("end_ts") > now - active_ms).alias("active"), F.count_if(F.col("end_ts") > now - short_ms).alias("short_term"), F.count("*").alias("long_term")]
    out = found.groupBy(*by).agg(*counts)
    if top is not None:
        first = out.orderBy(F.desc("short_term"), *by).limit(top)
        rest = out.join(first.select(*[F.coalesce(F.concat(F.lit("="), b), F.lit("")).alias(f"__{b}") for b in by]), [F.coalesce(F.concat(F.lit("="), F.col(b)), F.lit("")) == F.col(f"__{b}") for b in by], "left_anti")
        sums = rest.agg(*[F.sum(c).alias(c) for c in ("active", "short_term", "long_term")]).filter("long_term is not null")
        out = first.unionByName(sums.select(*[F.lit("_overflow_").alias(b) for b in by], "active", "short_term", "long_term"))
    return out.orderBy(F.desc("short_term"), *by)


def value_frequencies(table: MetricTable, label: str, top: int, matchers: tuple[Matcher, ...] = ()) -> DataFrame:
    """The label's most frequent values, by series."""
    return series(table, matchers).groupBy(F.col(label).alias("value")).agg(F.count("*").alias("series")).orderBy(F.desc("series"), "value").limit(top)


def check_quota(table: MetricTable, by: Iterable[str], quota: int) -> DataFrame:
    """Groups with more series than the quota."""
    return series(table).groupBy(*by).agg(F.count("*").alias("series")).filter(F.col("series") > quota)


def quota_tree(table: MetricTable, by: Iterable[str], quotas: Mapping[tuple[str, ...], int] | None = None, default: int | None = None) -> DataFrame:
    """Every prefix of the labels `by` with its series, its children (next-level values, or series at the last level), its quota of children, and
    whether they exceed it. quotas: by values of a prefix; default: for all other prefixes. One aggregation of the series, then sums of sums."""
    by = list(by)
    level = series(table).groupBy(*by).agg(F.count("*").alias("series")).withColumn("children", F.col("series"))
    levels = [level]
    for d in range(len(by) - 1, -1, -1):
        level = level.groupBy(*by[:d]).agg(F.sum("series").alias("series"), F.count("*").alias("children")) if d else level.agg(F.coalesce(F.sum("series"), F.lit(0)).alias("series"), F.count("*").alias("children"))
        levels.append(level)
    out = None
    for d, df in zip(range(len(by), -1, -1), levels, strict=True):
        quota = F.lit(default).cast("long")
        for prefix, n in (quotas or {}).items():
            if len(prefix) == d:
                quota = F.when(reduce(and_, [F.col(b) == v for b, v in zip(by, prefix, strict=False)], F.lit(True)), F.lit(n).cast("long")).otherwise(quota)
        part = df.select(F.lit(d).alias("depth"), *[F.col(b) if b in by[:d] else F.lit(None).cast("string").alias(b) for b in by], "series", "children", quota.alias("quota"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("breached", F.coalesce(F.col("children") > F.col("quota"), F.lit(False)))


def enforce_quotas(tree: DataFrame) -> DataFrame:
    """The tree, or LimitError with some of its breaches."""
    bad = tree.filter("breached").orderBy("depth", *[c for c in tree.columns if c not in ("depth", "series", "children", "quota", "breached")]).limit(5).collect()
    if bad:
        raise LimitError("quota exceeded: " + "; ".join(str(tuple(r)) for r in bad))
    return tree


def publish_interval(df: DataFrame, label: str = "_pi_") -> DataFrame:
    """The interval in ms at which a series is published, from a label that gives it in seconds; null without one."""
    seconds = F.expr(f"try_cast(`{label}` as bigint)") if label in df.columns else F.lit(None).cast("long")
    return df.withColumn("publish_ms", seconds * 1000)


def metering(table: MetricTable, by: Iterable[str], now: int) -> DataFrame:
    """Cardinalities as gauge samples at the time `now`."""
    by = list(by)
    counts = cardinalities(table, by, now)
    kinds = F.explode(F.array(*[F.struct(F.lit(f"tsdb_metering_{c}").alias(METRIC), F.col(c).cast("double").alias("value")) for c in ("active", "short_term", "long_term")])).alias("x")
    return counts.select(*by, kinds).select(*by, f"x.{METRIC}", F.lit(now).cast("long").alias("ts"), "x.value")


def file_chunks(df: DataFrame, ts: str) -> DataFrame:
    """One row per stored file: rows, first and last time, bytes."""
    return df.groupBy(F.col("_metadata.file_name").alias("chunk")).agg(F.count("*").alias("n_rows"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.max("_metadata.file_size").alias("n_bytes"))


def churn(table: MetricTable, by: str, labels: Iterable[str], now: int, days: tuple[int, int] = (3, 7)) -> DataFrame:
    """Per group and label: series active now, in either number of days, and distinct values by a sketch."""
    found = series(table)
    day = 86_400_000
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("value")) for n in labels])).alias("x")
    rows = found.select(F.col(by).alias("group"), "end_ts", each).select("group", "end_ts", "x.label", "x.value").filter("value is not null")
    return rows.groupBy("group", "label").agg(
        F.count_if(F.col("end_ts") > now - 3_600_000).alias("active"),
        F.count_if(F.col("end_ts") > now - days[0] * day).alias(f"ts_{days[0]}d"),
        F.count_if(F.col("end_ts") > now - days[1] * day).alias(f"ts_{days[1]}d"),
        F.hll_sketch_estimate(F.hll_sketch_agg("value", F.lit(12))).alias("distinct_values"),
    )
