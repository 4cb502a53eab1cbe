"""Data model: column types, data schemas, metric tables and the vectors that plans are made of.

Labels are plain string columns, null where a series lacks the label, so that grouping, joining and pruning are Catalyst's own; a
map of labels is expanded once, when a table is registered.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRIC, LE, TS, VALUE = "_metric_", "le", "ts", "value"
NAN, INF = float("nan"), float("inf")

HISTOGRAM = T.StructType([T.StructField("les", T.ArrayType(T.DoubleType())), T.StructField("counts", T.ArrayType(T.DoubleType()))])

#: The column types and their Spark counterparts.
COLUMN_TYPES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "ts": T.LongType(),
    "map": T.MapType(T.StringType(), T.StringType()),
    "hist": HISTOGRAM,
}


class QueryError(ValueError):
    """A query that is malformed or not allowed."""


class LimitError(QueryError):
    """A query that goes beyond a limit of the settings."""


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: str
    params: Mapping[str, str] = field(default_factory=dict)

    @property
    def cumulative(self) -> bool:
        return self.params.get("detectDrops") == "true" or self.params.get("counter") == "true"


def parse_column(text: str) -> ColumnDef:
    """`name:type` or `name:type:k=v,...`, braces around the parameters allowed."""
    parts = text.split(":", 2)
    if len(parts) < 2 or not parts[0]:
        raise QueryError(f"a column is name:type:params, not {text!r}")
    name, kind = parts[:2]
    if kind not in COLUMN_TYPES:
        raise QueryError(f"no column type {kind!r}")
    params = dict(p.strip().split("=", 1) for p in parts[2].strip("{}").split(",") if p.strip()) if len(parts) == 3 else {}
    if kind == "hist" and "counter" not in params:
        raise QueryError(f"histogram column {name} needs counter=true or false")
    return ColumnDef(name, kind, params)


@dataclass(frozen=True)
class DataSchema:
    """Columns after the timestamp, the value column, and how a rollup is made of them."""

    name: str
    columns: tuple[ColumnDef, ...]
    value_column: str
    downsamplers: tuple[str, ...] = ()
    downsample_schema: str | None = None

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise QueryError(f"schema {self.name} has no column {name}")

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField("timestamp", T.LongType())] + [T.StructField(c.name, COLUMN_TYPES[c.kind]) for c in self.columns])


def _schema(name: str, columns: str, value: str, downsamplers: str = "", to: str | None = None) -> DataSchema:
    return DataSchema(name, tuple(parse_column(c) for c in columns.split()), value, tuple(downsamplers.split()), to)


_CUM, _DELTA = "double:detectDrops=true", "double:detectDrops=false,delta=true"
#: The built-in data schemas.
SCHEMAS: dict[str, DataSchema] = {
    s.name: s
    for s in (
        _schema("gauge", "value:double:detectDrops=false", "value", "tTime(0) dMin(1) dMax(1) dSum(1) dCount(1) dAvg(1)", "ds-gauge"),
        _schema("untyped", "number:double", "number"),
        _schema("prom-counter", f"count:{_CUM}", "count", "tTime(0) dLast(1)", "prom-counter"),
        _schema("delta-counter", f"count:{_DELTA}", "count", "tTime(0) dSum(1)", "delta-counter"),
        _schema("prom-histogram", f"sum:{_CUM} count:{_CUM} h:hist:counter=true", "h", "tTime(0) dLast(1) dLast(2) hLast(3)", "prom-histogram"),
        _schema("delta-histogram", f"sum:{_DELTA} count:{_DELTA} h:hist:counter=false,delta=true", "h", "tTime(0) dSum(1) dSum(2) hSum(3)", "delta-histogram"),
        _schema("otel-cumulative-histogram", f"sum:{_CUM} count:{_CUM} h:hist:counter=true min:{_CUM} max:{_CUM}", "h", "tTime(0) dLast(1) dLast(2) hLast(3) dMin(4) dMax(5)", "otel-cumulative-histogram"),
        _schema("otel-delta-histogram", f"sum:{_DELTA} count:{_DELTA} h:hist:counter=false,delta=true min:{_DELTA} max:{_DELTA}", "h", "tTime(0) dSum(1) dSum(2) hSum(3) dMin(4) dMax(5)", "otel-delta-histogram"),
        _schema("delta-histogram-v2", f"sum:{_DELTA} count:{_DELTA} h:hist:counter=false,delta=true min:{_DELTA} max:{_DELTA} sumLast:{_DELTA}", "h"),
        _schema("otel-exp-delta-histogram", f"sum:{_DELTA} count:{_DELTA} h:hist:counter=false,delta=true,exp=true min:{_DELTA} max:{_DELTA}", "h"),
        _schema("preagg-gauge", "count:double min:double sum:double max:double", "sum"),
        _schema("preagg-gauge-v2", "count:double min:double sum:double max:double countl:double minl:double suml:double maxl:double", "sum"),
        _schema("preagg-delta-counter", f"count:{_DELTA} min:{_DELTA} sum:{_DELTA} max:{_DELTA}", "sum"),
        _schema("preagg-delta-histogram", f"sum:{_DELTA} count:{_DELTA} tscount:{_DELTA} h:hist:counter=false,delta=true", "h"),
        _schema("preagg-otel-delta-histogram", f"sum:{_DELTA} count:{_DELTA} tscount:{_DELTA} h:hist:counter=false,delta=true min:{_DELTA} max:{_DELTA}", "h"),
        _schema("preagg-otel-exp-delta-histogram", f"sum:{_DELTA} count:{_DELTA} tscount:{_DELTA} h:hist:counter=false,delta=true,exp=true min:{_DELTA} max:{_DELTA}", "h"),
        _schema("preagg-delta-histogram-v2", f"sum:{_DELTA} count:{_DELTA} tscount:{_DELTA} h:hist:counter=false,delta=true min:{_DELTA} max:{_DELTA} sumLast:{_DELTA}", "h"),
        _schema("ds-gauge", "min:double max:double sum:double count:double avg:double", "avg", "tTime(0) dMin(1) dMax(2) dSum(3) dSum(4) dAvgAc(5@4)", "ds-gauge"),
    )
}


def validate_schemas(schemas: Mapping[str, DataSchema]) -> None:
    """Value columns exist, and rollups name known schemas."""
    for s in schemas.values():
        s.column(s.value_column)
        if s.downsample_schema and s.downsample_schema not in schemas:
            raise QueryError(f"schema {s.name} rolls up into unknown {s.downsample_schema}")


@dataclass(frozen=True)
class Config:
    """Engine settings."""

    stale_ms: int = 300_000
    inclusive_range: bool = True
    min_step_ms: int = 5_000
    sample_limit: int = 1_000_000
    regex_limit: int = 1_000
    regex_or_limit: int = 10_000
    count_values_limit: int = 1_000
    join_limit: int = 25_000
    group_limit: int = 1_000
    scan_bytes_limit: int | None = None
    #: whether queries are refused beyond sample, join, group and byte limits; that needs jobs before the result
    enforce: bool = False
    subquery_step_ms: int = 60_000


@dataclass(frozen=True)
class MetricTable:
    """Samples of one metric: label columns, a time column (timestamp or epoch ms), value columns of a schema."""

    name: str
    df: DataFrame
    labels: tuple[str, ...]
    time: str = TS
    schema: str = "gauge"
    columns: Mapping[str, str] = field(default_factory=dict)  # schema column -> table column
    day: str | None = None  # a date column that the files are partitioned by
    catalogue: DataFrame | None = None  # labels, start_ts and end_ts of parts of the series; questions about series then read no samples

    def source(self, column: str) -> str:
        return self.columns.get(column, column)


@dataclass(frozen=True)
class Vector:
    """Rows (labels..., ts, value); for histograms one row per bucket, its upper bound in __le, and the histogram's extremes in __max and __min if they were asked for."""

    df: DataFrame
    labels: tuple[str, ...]
    histogram: bool = False
    exponential: bool = False

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.labels, "__le") if self.histogram else self.labels

    @property
    def extremes(self) -> tuple[str, ...]:
        return tuple(c for c in ("__max", "__min") if self.histogram and c in self.df.columns)

    def with_df(self, df: DataFrame) -> Vector:
        return Vector(df, self.labels, self.histogram, self.exponential)


@dataclass(frozen=True)
class Grid:
    """Instants start, start + step, ... up to end, in milliseconds; step 0 is the single instant start."""

    start: int
    step: int
    end: int

    def __post_init__(self) -> None:
        if self.end < self.start or (self.step <= 0 and self.end != self.start):
            raise QueryError("a range needs start <= end and a positive step")

    @property
    def each(self) -> int:
        return self.step or 1

    @property
    def n(self) -> int:
        return (self.end - self.start) // self.each + 1

    def shifted(self, ms: int) -> Grid:
        return Grid(self.start + ms, self.step, self.end + ms)

    def frame(self, spark) -> DataFrame:
        return spark.range(self.n).select((F.lit(self.start) + F.col("id") * self.each).cast("long").alias(TS))


def present(value: Column) -> Column:
    """NaN means no sample."""
    return F.when(~F.isnan(value), value)


def double(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def expand_labels(df: DataFrame, labels: str, names: Iterable[str] | None = None) -> tuple[DataFrame, tuple[str, ...]]:
    """Turn a map of labels into columns. Names not given are read from the data, once."""
    if names is None:
        names = sorted(r[0] for r in df.select(F.explode(F.map_keys(labels))).distinct().toLocalIterator())
    names = tuple(names)
    return df.select("*", *[F.try_element_at(labels, F.lit(n)).alias(n) for n in names]).drop(labels), names


# histogram bucket schemes


def geometric(first: float, multiplier: float, n: int, minus_one: bool = False) -> list[float]:
    return [first * multiplier**i - (1 if minus_one else 0) for i in range(n)]


MAX_SCALE, MAX_BUCKETS = 20, 180


def exponential(scale: int, start: int, positive: int) -> list[float]:
    """Bound 0 holds zeros; bound i is base^(start + i) with base = 2^(2^-scale)."""
    if abs(scale) > MAX_SCALE or not 0 <= positive <= MAX_BUCKETS:
        raise QueryError("exponential buckets need |scale| <= 20 and at most 180 positive buckets")
    return [0.0] + [2.0 ** (2.0**-scale * (start + i)) for i in range(1, positive + 1)]


def rescale_exponential(scale: int, start: int, counts: list[float], to_scale: int, to_start: int, to_n: int) -> list[float]:
    """Cumulative counts (bucket 0 first) on a coarser or equal scale that covers the same range."""
    if to_scale > scale:
        raise QueryError("a scale can only be made coarser")
    ratio = 1 << (scale - to_scale)
    out = []
    for i in range(to_n + 1):
        if i == 0:
            out.append(counts[0])
            continue
        upto = (to_start + i) * ratio - start  # buckets of the old scheme with bounds <= this one's
        out.append(counts[max(0, min(len(counts) - 1, upto))])
    return out


def merge_exponential(a: tuple[int, int, list[float]], b: tuple[int, int, list[float]]) -> tuple[int, int, list[float]]:
    """Sum of two exponential histograms (scale, start, cumulative counts) on their common scale."""
    scale = min(a[0], b[0])
    while True:
        lo, hi = [], []
        for s, start, counts in (a, b):
            r = 1 << (s - scale)
            lo.append(math.floor(start / r))
            hi.append(math.ceil((start + len(counts) - 1) / r))
        start, n = min(lo), max(hi) - min(lo)
        if n <= MAX_BUCKETS:
            break
        scale -= 1
    x = rescale_exponential(*a, scale, start, n)
    y = rescale_exponential(*b, scale, start, n)
    return scale, start, [p + q for p, q in zip(x, y, strict=True)]
