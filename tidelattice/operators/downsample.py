"""Downsampling to tumbling periods, choosing between raw samples and rollups, and the batch jobs around them."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..model import SCHEMAS, TS, MetricTable, QueryError, Vector
from ..plans.parser import Matcher
from .grid import stitch
from .select import between, epoch_ms, filtered, in_range, raw


@dataclass(frozen=True)
class DownsampleConfig:
    """Resolutions in ms, finest first, and how long each is kept (ms)."""

    resolutions: tuple[int, ...]
    ttls: tuple[int, ...]
    raw_ttl: int = 7 * 86_400_000

    def __post_init__(self) -> None:
        if len(self.resolutions) != len(self.ttls) or list(self.resolutions) != sorted(set(self.resolutions)) or list(self.ttls) != sorted(self.ttls):
            raise QueryError("resolutions and retentions are equally many and ascending")

    def resolution_for(self, start: int, now: int) -> int:
        """0 for raw samples, or the finest rollup that still has the start."""
        if start >= now - self.raw_ttl:
            return 0
        for r, ttl in zip(self.resolutions, self.ttls, strict=True):
            if start >= now - ttl:
                return r
        return self.resolutions[-1]


def period(ts: Column, resolution: int) -> Column:
    """End of the period (k * resolution, (k + 1) * resolution] that holds ts."""
    return (F.ceil(ts / resolution) * resolution).cast("long")


_CALL = re.compile(r"(\w+)\(([\d@]+)\)")


def _reducer(name: str, columns: list[Column]) -> Column:
    x = columns[0]
    value = F.when(~F.isnan(x), x) if name.startswith("d") else x
    match name:
        case "tTime":
            return F.max(TS)
        case "dMin":
            return F.min(value)
        case "dMax":
            return F.max(value)
        case "dSum":
            return F.sum(value)
        case "dCount":
            return F.count(value).cast("double")
        case "dAvg":
            return F.avg(value)
        case "dLast" | "hLast":
            return F.max_by(x, TS)
        case "dAvgAc":  # mean of means, weighted by counts
            return F.sum(value * columns[1]) / F.sum(F.when(value.isNotNull(), columns[1]))
        case "dAvgSc":  # sums by counts
            return F.sum(value) / F.sum(columns[1])
    raise QueryError(f"no downsampler {name}")


_NAMES = {"dMin": "min", "dMax": "max", "dSum": "sum", "dCount": "count", "dAvg": "avg", "dAvgAc": "avg", "dAvgSc": "avg"}


def downsample(table: MetricTable, resolution: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """Roll a table up by its schema's downsamplers: labels, period (its end), ts (last sample in it), values."""
    schema = SCHEMAS[table.schema]
    if not schema.downsamplers:
        raise QueryError(f"schema {schema.name} has no rollup")
    # in the column's own type, so that files and row groups are skipped; a period does not hold its start
    df = in_range(table, (), None if start is None else start + 1, end)
    df = df.withColumn(TS, epoch_ms(df, table.time))
    df = df.withColumn("period", period(F.col(TS), resolution))
    columns = [F.col(TS), *[F.col(table.source(c.name)) for c in schema.columns]]
    out, hist = [], None
    same = schema.downsample_schema == schema.name
    for k, text in enumerate(schema.downsamplers):
        name, numbers = _CALL.fullmatch(text).groups()
        used = [columns[int(i)] for i in numbers.split("@")]
        if name == "hSum":
            hist = (schema.columns[int(numbers) - 1].name, used[0])
            continue
        target = "ts" if name == "tTime" else schema.columns[k - 1].name if same else _NAMES[name]
        out.append(_reducer(name, used).alias(target if target != TS or name == "tTime" else "value"))
    keys = [*table.labels, "period"]
    rolled = df.groupBy(*keys).agg(*out)
    if hist is None:
        return rolled
    cells = df.select(*keys, F.explode(F.arrays_zip(hist[1]["les"].alias("le"), hist[1]["counts"].alias("n"))).alias("b"))
    sums = cells.groupBy(*keys, F.col("b.le").alias("le")).agg(F.sum("b.n").alias("n"))
    again = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("b"))
    h = F.struct(F.transform("b", lambda x: x["le"]).alias("les"), F.transform("b", lambda x: x["n"]).alias("counts")).alias(hist[0])
    return rolled.join(again.select(*keys, h), keys)


def counter_rows(v: Vector, resolution: int) -> DataFrame:
    """Samples of a counter to keep: the last of each period, the first of all, and each drop with its predecessor."""
    w = Window.partitionBy(*v.labels).orderBy(TS)
    in_period = Window.partitionBy(*v.labels, "period").orderBy(F.desc(TS))
    df = v.df.withColumn("period", period(F.col(TS), resolution))
    marks = df.withColumns({"__last": F.row_number().over(in_period) == 1, "__first": F.row_number().over(w) == 1, "__drop": F.coalesce(F.lag("value").over(w) > F.col("value"), F.lit(False)), "__before": F.coalesce(F.lead("value").over(w) < F.col("value"), F.lit(False))})
    return marks.filter("__last or __first or __drop or __before").select(*v.labels, TS, "value")


def routed(raw_part: Vector, rollup_part: Vector, earliest_raw: int) -> Vector:
    """Rollup results before the earliest raw time, raw results from there on."""
    old = rollup_part.with_df(rollup_part.df.filter(F.col(TS) < earliest_raw))
    return stitch([old, raw_part.with_df(raw_part.df.filter(F.col(TS) >= earliest_raw))])


#: Which rollup column, and which function over it, stands for a function of the raw gauge.
ON_ROLLUP = {
    "sum_over_time": ("sum", "sum_over_time"),
    "count_over_time": ("count", "sum_over_time"),
    "min_over_time": ("min", "min_over_time"),
    "max_over_time": ("max", "max_over_time"),
    "avg_over_time": ("avg", None),  # sums by counts
}


@dataclass(frozen=True)
class ExportRule:
    """Groups of matchers: a series is exported if it passes every allow group reached before a block group that it passes."""

    allow: tuple[tuple[Matcher, ...], ...] = ()
    block: tuple[tuple[Matcher, ...], ...] = ()
    drop_labels: tuple[str, ...] = ()
    columns: tuple[tuple[str, str], ...] = ()  # label -> column


def _passes(matchers: tuple[Matcher, ...], labels: Iterable[str]) -> Column:
    from .select import matches

    out = F.lit(True)
    for m in matchers:
        test = matches(F.col(m.label) if m.label in labels else F.lit(None).cast("string"), m.op, m.value)
        if test is not None:
            out = out & F.coalesce(test, F.lit(False))
    return out


def export(table: MetricTable, rule: ExportRule, start: int, end: int) -> DataFrame:
    """Raw samples for export with year, month, day and hour columns; histograms become _bucket series."""
    from .histogram import to_le_series

    v = raw(table, (), start, end)
    if v.histogram:
        v = to_le_series(v)
    blocked = F.lit(False)
    for g in rule.block:
        blocked = blocked | _passes(g, v.labels)
    allowed = F.lit(not rule.allow)
    for g in rule.allow:
        allowed = allowed | _passes(g, v.labels)
    at = F.timestamp_millis(TS)
    renamed = dict(rule.columns)
    keep = [F.col(x).alias(renamed.get(x, x)) for x in v.labels if x not in rule.drop_labels]
    return v.df.filter(allowed & ~blocked).select(*keep, TS, "value", F.year(at).alias("year"), F.month(at).alias("month"), F.day(at).alias("day"), F.hour(at).alias("hour"))


def write_export(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("year", "month", "day", "hour").parquet(path)


def delete_series(table: MetricTable, matchers: tuple[Matcher, ...], start: tuple[int, int], end: tuple[int, int], simulate: bool = False) -> DataFrame:
    """Samples without the series that match and whose first and last times lie in the ranges; or, simulated, those series."""
    from .select import series

    doomed = series(table, matchers).filter(F.col("start_ts").between(*start) & F.col("end_ts").between(*end))
    if simulate:
        return doomed
    mark = lambda df: df.withColumns({f"__k{i}": F.coalesce(F.concat(F.lit("="), x), F.lit("")) for i, x in enumerate(table.labels)})
    keys = [f"__k{i}" for i in range(len(table.labels))]
    return mark(table.df).join(mark(doomed).select(*keys), keys, "left_anti").drop(*keys)


def copied(source: DataFrame, ts: str, start: int, end: int) -> DataFrame:
    """Rows of a time range, for repair."""
    return between(source, ts, start, end)


def differences(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of either side without a counterpart, with the side they are on."""
    a = source.exceptAll(target).withColumn("side", F.lit("source"))
    return a.unionByName(target.exceptAll(source).withColumn("side", F.lit("target")))


def purge(table: MetricTable, now: int, ttl: int) -> DataFrame:
    return in_range(table, (), now - ttl, None)


def keep_matching(table: MetricTable, matchers: tuple[Matcher, ...]) -> DataFrame:
    return filtered(table.df, table.labels, matchers)
