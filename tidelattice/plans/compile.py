"""Syntax tree to DataFrame. Nothing is executed here: the result is one declarative plan."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.instant import ARITHMETIC, BINARY, DATES, UNARY, compared, fold
from ..functions.range_functions import RANGE
from ..model import INF, METRIC, SCHEMAS, TS, VALUE, Config, Grid, MetricTable, QueryError, Vector
from ..limits import Probe, Stats
from ..operators import aggregate as agg
from ..operators import histogram as hist
from ..operators import join, labels
from ..operators.grid import repeat, resample, stitch
from ..operators.select import holds, raw
from .parser import AGGREGATES, SET_OPS, Aggregate, Binary, Call, Limit, Matcher, Node, Number, Selector, Subquery, Text, is_scalar
from .rewrite import AggregationRule, folded, histogram_names, preaggregated

__all__ = ["AGGREGATES", "Compiler", "Scalar"]

#: Columns of a histogram's largest and least observation.
EXTREMES = ("max", "min")


@dataclass(frozen=True)
class Scalar:
    """A number, or one value per instant as (ts, value)."""

    value: float | DataFrame


class Compiler:
    def __init__(self, spark: SparkSession, tables: dict[str, list[MetricTable]], config: Config, rules: list[AggregationRule] = (), functions: dict[str, Callable] | None = None, extremes: bool = False, stats: Stats | None = None):
        self.spark, self.tables, self.config, self.rules = spark, tables, config, list(rules)
        self.functions, self.extremes, self.stats = functions or {}, extremes, stats
        self.probes: list[Probe] = []

    def prepared(self, n: Node) -> Node:
        n = preaggregated(n, self.rules)
        n = histogram_names(n, lambda m: m in self.tables, self._is_histogram)
        return folded(n)

    def _is_histogram(self, metric: str) -> bool:
        return any(SCHEMAS[t.schema].column(SCHEMAS[t.schema].value_column).kind == "hist" for t in self.tables.get(metric, ()))

    def run(self, n: Node, grid: Grid) -> Vector | Scalar:
        n = self.prepared(n)
        if isinstance(n, Selector) and n.window is not None:
            if grid.start != grid.end:
                raise QueryError("a range selector is a result only at a single instant")
            return self.samples(n, grid)
        if isinstance(n, Subquery):
            if grid.start != grid.end:
                raise QueryError("a subquery is a result only at a single instant")
            return self.eval(n.inner, self.inner_grid(n, grid))
        return self.eval(n, grid)

    def eval(self, n: Node, grid: Grid) -> Vector | Scalar:
        match n:
            case Number():
                return Scalar(n.value)
            case Selector():
                return self.instant(n, grid)
            case Aggregate():
                return self.aggregate(n, grid)
            case Limit():
                return labels.limit(self.vector(n.inner, grid), n.n)
            case Binary():
                return self.binary(n, grid)
            case Call():
                return self.call(n, grid)
        raise QueryError(f"cannot evaluate {n}")

    def vector(self, n: Node, grid: Grid) -> Vector:
        got = self.eval(n, grid)
        if isinstance(got, Scalar):
            raise QueryError("a vector is needed")
        return got

    # selectors

    def matched(self, n: Selector) -> list[tuple[MetricTable, Selector]]:
        """The tables that the selector reads, with schema and bucket pseudo-labels resolved."""
        named = [m for m in n.matchers if m.label in ("__name__", METRIC)]
        rest = tuple(m for m in n.matchers if m not in named)
        kind = [m for m in rest if m.label == "_type_"]
        rest = tuple(m for m in rest if m.label != "_type_")
        for m in kind:
            if m.op != "=" or m.value not in SCHEMAS:
                raise QueryError("_type_ takes equality with a known schema")
        names = [n.metric] if n.metric is not None else [m for m in self.tables if all(holds(m, x.op, x.value) for x in named)]
        found = [t for m in names for t in self.tables.get(m, ()) if all(t.schema == k.value for k in kind)]
        return [(t, replace(n, metric=t.name, matchers=rest)) for t in found]

    def bounds(self, n: Selector, grid: Grid) -> tuple[int, int]:
        """Window in ms (with its steps), and whether closed."""
        return round(n.window + n.window_steps * grid.step), grid.step

    def at(self, n: Selector | Subquery, grid: Grid) -> int | None:
        if n.at is None:
            return None
        return {"start": grid.start, "end": grid.end}.get(n.at) if isinstance(n.at, str) else round(n.at * 1000)

    def read(self, n: Selector, table: MetricTable, start: int, end: int) -> Vector:
        bucket = [m for m in n.matchers if m.label == "_bucket_"]
        schema = SCHEMAS[table.schema]
        held = {c.name for c in schema.columns} & set(EXTREMES)
        wanted = [c for c in EXTREMES if self.extremes and n.column in (None, schema.value_column) and c in held and table.source(c) in table.df.columns]
        v = raw(table, [m for m in n.matchers if m.label != "_bucket_"], start, end, n.column, wanted)
        if self.stats is not None:
            v = self.stats.reading(table.name, v)
        for m in bucket:
            v = hist.histogram_bucket(INF if m.value in ("+Inf", "Inf") else float(m.value), v)
        return v

    def empty(self) -> Vector:
        return Vector(self.spark.createDataFrame([], f"{METRIC} string, {TS} long, {VALUE} double"), (METRIC,))

    def over(self, n: Selector, grid: Grid, window: int, name: str, args: tuple[float, ...] = ()) -> Vector:
        """A range function over raw samples of all matched tables."""
        fixed = self.at(n, grid)
        inner = Grid(fixed, 0, fixed) if fixed is not None else grid
        parts = []
        for table, s in self.matched(n):
            v = self.read(s, table, inner.start - window - n.offset, inner.end - n.offset)
            used = self.function(name, table, s, v)
            inclusive = self.config.inclusive_range or name in ("last", "timestamp")
            if name == "avg_over_time" and table.schema == "ds-gauge" and n.column is None:
                a = resample(self.read(replace(s, column="sum"), table, inner.start - window - n.offset, inner.end - n.offset), inner, window, RANGE["sum_over_time"], offset=n.offset, inclusive=inclusive)
                b = resample(self.read(replace(s, column="count"), table, inner.start - window - n.offset, inner.end - n.offset), inner, window, RANGE["sum_over_time"], offset=n.offset, inclusive=inclusive)
                parts.append(join.combine(a, b, "/"))
                continue
            parts.append(resample(v, inner, window, used, offset=n.offset, inclusive=inclusive, args=args))
        if not parts:
            return self.empty()
        got = parts[0] if len(parts) == 1 else unioned(parts)
        return repeat(got, grid) if fixed is not None else got

    def function(self, name: str, table: MetricTable, s: Selector, v: Vector):
        """The function for the column's temporality; some are not defined for histograms."""
        schema = SCHEMAS[table.schema]
        column = schema.column(s.column or schema.value_column)
        delta = column.params.get("delta") == "true"
        if delta and name in ("rate", "increase", "irate"):
            name = f"{name}_of_deltas" if name != "irate" or not v.histogram else "irate_of_histogram_deltas"
        if table.schema == "ds-gauge" and name == "count_over_time" and s.column is None:
            name = "sum_over_time"
        used = RANGE[name]
        if v.histogram and not used.histogram:
            raise QueryError(f"{name} is not defined for histograms")
        return used

    def instant(self, n: Selector, grid: Grid, name: str = "last") -> Vector:
        # one millisecond more than the staleness: a sample exactly that old still counts
        return self.over(n, grid, self.config.stale_ms + 1, name)

    def samples(self, n: Selector, grid: Grid) -> Vector:
        fixed = self.at(n, grid)
        end = (fixed if fixed is not None else grid.end) - n.offset
        window, _ = self.bounds(n, grid)
        parts = [self.read(s, t, end - window, end) for t, s in self.matched(n)]
        return unioned(parts) if parts else self.empty()

    # subqueries

    def inner_grid(self, n: Subquery, grid: Grid) -> Grid:
        """Multiples of the subquery's step that the outer windows reach."""
        step = n.step or self.config.subquery_step_ms
        fixed = self.at(n, grid)
        lo, hi = (fixed, fixed) if fixed is not None else (grid.start, grid.end)
        first = -(-(lo - n.window - n.offset) // step) * step
        last = (hi - n.offset) // step * step
        return Grid(first, step, max(first, last))

    def ranged(self, n: Node, grid: Grid, name: str, args: tuple[float, ...] = ()) -> Vector:
        if isinstance(n, Selector):
            window, _ = self.bounds(n, grid)
            if name in ("sum_over_time", "count_over_time", "min_over_time", "max_over_time") and n.column is None:
                n = self.rollup_column(n, name)
            return self.over(n, grid, window, name, args)
        used = RANGE["last_of_results" if name in ("last", "last_over_time") else name]
        if not used.subquery:
            raise QueryError(f"{name} is not defined over subqueries")
        inner = self.vector(n.inner, self.inner_grid(n, grid))
        fixed = self.at(n, grid)
        at = Grid(fixed, 0, fixed) if fixed is not None else grid
        got = resample(inner, at, n.window, used, offset=n.offset, args=args)
        return repeat(got, grid) if fixed is not None else got

    def rollup_column(self, n: Selector, name: str) -> Selector:
        from ..operators.downsample import ON_ROLLUP

        tables = self.matched(n)
        if tables and all(t.schema == "ds-gauge" for t, _ in tables):
            return replace(n, column=ON_ROLLUP[name][0])
        return n

    # operators

    def scalar_of(self, n: Node, grid: Grid) -> float | DataFrame:
        got = self.eval(n, grid)
        if not isinstance(got, Scalar):
            raise QueryError("a scalar is needed")
        return got.value

    def number(self, n: Node, grid: Grid) -> float:
        value = self.scalar_of(n, grid)
        if isinstance(value, DataFrame):
            raise QueryError("this parameter must be a number")
        return value

    def aggregate(self, n: Aggregate, grid: Grid) -> Vector:
        param = n.param.value if isinstance(n.param, Text) else None if n.param is None else self.number(n.param, grid)
        got = agg.aggregate(self.vector(n.inner, grid), n.op, n.by, n.without, param, self.config.count_values_limit)
        if n.op not in ("topk", "bottomk") and got.labels:
            self.probes.append(Probe("groups of an aggregation", got, self.config.group_limit))
        return got

    def binary(self, n: Binary, grid: Grid) -> Vector | Scalar:
        if is_scalar(n.left) and is_scalar(n.right):
            a, b = self.scalar_of(n.left, grid), self.scalar_of(n.right, grid)
            if not isinstance(a, DataFrame) and not isinstance(b, DataFrame):
                return Scalar(fold(n.op, a, b))
            l, r = self.frame(a, grid).withColumnRenamed(VALUE, "__a"), self.frame(b, grid).withColumnRenamed(VALUE, "__b")
            x, y = F.col("__a"), F.col("__b")
            value = ARITHMETIC[n.op](x, y) if n.op in ARITHMETIC else compared(n.op, x, y)
            return Scalar(l.join(r, TS).select(TS, value.cast("double").alias(VALUE)))
        if is_scalar(n.left) or is_scalar(n.right):
            scalar_left = is_scalar(n.left)
            v = self.vector(n.right if scalar_left else n.left, grid)
            return join.with_scalar(v, n.op, self.scalar_of(n.left if scalar_left else n.right, grid), scalar_left, n.bool_)
        left, right = self.vector(n.left, grid), self.vector(n.right, grid)
        if n.op in SET_OPS:
            return join.set_operation(left, right, n.op, n.on, n.ignoring)
        got = join.combine(left, right, n.op, on=n.on, ignoring=n.ignoring, group=n.group, include=n.include, bool_=n.bool_)
        sides = [("series of a join's result", got)] if n.group else [("series on the left of a join", left), ("series on the right of a join", right)]
        self.probes += [Probe(what, v, self.config.join_limit) for what, v in sides]
        return got

    def frame(self, value: float | DataFrame, grid: Grid) -> DataFrame:
        return value if isinstance(value, DataFrame) else grid.frame(self.spark).withColumn(VALUE, F.lit(float(value)).cast("double"))

    # functions

    def call(self, n: Call, grid: Grid) -> Vector | Scalar:
        name, args = n.name, n.args
        if name == "time" or name in DATES and not args:
            seconds = grid.frame(self.spark).withColumn(VALUE, F.col(TS) / 1000.0)
            return Scalar(seconds if name == "time" else seconds.withColumn(VALUE, DATES[name](F.col(VALUE))))
        if name == "scalar":
            return Scalar(self.single(self.vector(args[0], grid), grid))
        if name == "vector":
            return Vector(self.frame(self.scalar_of(args[0], grid), grid), ())
        if name == "absent_over_time":
            inner = self.ranged(args[0], grid, "last_of_results" if isinstance(args[0], Subquery) else "present_over_time")
            return labels.absent(inner, grid, self.equalities(args[0]))
        if name == "absent":
            return labels.absent(self.vector(args[0], grid), grid, self.equalities(args[0]))
        if name == "timestamp":
            if isinstance(args[0], Selector):
                return self.instant(args[0], grid, "timestamp")
            v = self.vector(args[0], grid)
            return v.with_df(v.df.withColumn(VALUE, F.col(TS) / 1000.0))
        if name in RANGE:
            ranged = next(a for a in args if isinstance(a, Subquery) or isinstance(a, Selector) and a.window is not None)
            rest = tuple(self.number(a, grid) for a in args if a is not ranged)
            return self.ranged(ranged, grid, name, rest)
        if name in self.functions:
            v = self.vector(args[0], grid)
            return self.mapped(v, self.functions[name](F.col(VALUE), *[F.lit(self.number(a, grid)).cast("double") for a in args[1:]]))
        if name in UNARY:
            v = self.vector(args[0], grid)
            return self.mapped(v, UNARY[name](F.col(VALUE)))
        if name in BINARY:
            return self.two(name, self.vector(args[0], grid), self.scalar_of(args[1], grid) if len(args) > 1 else 1.0, grid)
        if name in ("optimize_with_agg", "no_optimize"):
            return self.eval(args[0], grid)
        return self.other(name, args, grid)

    @staticmethod
    def mapped(v: Vector, value) -> Vector:
        return v.with_df(v.df.select(*v.keys, TS, value.cast("double").alias(VALUE)))

    def two(self, name: str, v: Vector, s: float | DataFrame, grid: Grid) -> Vector:
        if isinstance(s, DataFrame):
            joined = v.with_df(v.df.join(s.withColumnRenamed(VALUE, "__s"), TS))
            out = self.mapped(joined, BINARY[name](F.col(VALUE), F.col("__s")))
        else:
            out = self.mapped(v, BINARY[name](F.col(VALUE), F.lit(float(s)).cast("double")))
        if name != "or_vector":
            return out
        # without any series, the scalar itself
        none = v.df.select(F.lit(1).alias("one")).limit(1)
        alone = self.frame(s, grid).join(none.groupBy().count(), how="cross").filter("count = 0")
        return Vector(out.df.unionByName(alone.select(TS, VALUE), allowMissingColumns=True).select(*v.labels, TS, VALUE), v.labels)

    def single(self, v: Vector, grid: Grid) -> DataFrame:
        """The values of a vector with one series, else NaN at every instant."""
        series = F.xxhash64(*[F.coalesce(x, F.lit("")) for x in v.labels], F.lit(0))
        rows = v.df.groupBy(TS).agg(F.first(VALUE).alias(VALUE), F.min(series).alias("__lo"), F.max(series).alias("__hi"))
        # the vector is computed once: what meets in one task is a row an instant
        all_ = Window.partitionBy(F.lit(0))
        joined = grid.frame(self.spark).join(rows, TS, "left").withColumn("__one", F.min("__lo").over(all_) == F.max("__hi").over(all_))
        return joined.select(TS, F.when(F.col("__one"), F.coalesce(VALUE, F.lit(math.nan))).otherwise(F.lit(math.nan)).alias(VALUE))

    @staticmethod
    def equalities(n: Node) -> tuple[Matcher, ...]:
        while isinstance(n, Subquery):
            n = n.inner
        return n.matchers if isinstance(n, Selector) else ()

    def other(self, name: str, args: tuple[Node, ...], grid: Grid) -> Vector:
        texts = [a.value for a in args if isinstance(a, Text)]
        last = lambda: self.vector(args[-1], grid)
        match name:
            case "label_replace":
                return labels.label_replace(self.vector(args[0], grid), *texts)
            case "label_join":
                return labels.label_join(self.vector(args[0], grid), *texts)
            case "sort" | "sort_desc":
                return labels.sort(last(), name == "sort_desc")
            case "limit":
                return labels.limit(last(), int(self.number(args[0], grid)))
            case "histogram_quantile":
                return hist.histogram_quantile(self.number(args[0], grid), last())
            case "histogram_fraction":
                return hist.histogram_fraction(self.number(args[0], grid), self.number(args[1], grid), last())
            case "histogram_bucket":
                return hist.histogram_bucket(self.number(args[0], grid), last())
            case "hist_to_prom_vectors":
                return hist.to_le_series(last())
            case "histogram_max_quantile" | "histogram_max_quantile_even":
                before, self.extremes = self.extremes, True
                v, self.extremes = last(), before
                return hist.histogram_max_quantile(self.number(args[0], grid), v, name.endswith("even"))
            case "chunk_meta":
                return self.chunk_meta(args[0], grid)
        raise QueryError(f"no function {name}")

    def chunk_meta(self, n: Node, grid: Grid) -> Vector:
        """Rows stored per series in the range, as value."""
        if not isinstance(n, Selector):
            raise QueryError("chunk metadata belongs to a selector")
        parts = []
        for t, s in self.matched(n):
            v = self.read(s, t, grid.start, grid.end)
            parts.append(v.with_df(v.df.groupBy(*v.keys).agg(F.max(TS).alias(TS), F.count("*").cast("double").alias(VALUE))))
        return unioned(parts) if parts else self.empty()


def unioned(parts: list[Vector]) -> Vector:
    names = tuple(dict.fromkeys(x for p in parts for x in p.labels))
    if len({p.histogram for p in parts}) > 1:
        raise QueryError("histograms and plain series are mixed")
    df = parts[0].df
    for p in parts[1:]:
        df = df.unionByName(p.df, allowMissingColumns=True)
    bucket = ["__le"] if parts[0].histogram else []
    more = [c for c in parts[0].extremes if all(c in p.extremes for p in parts)]
    return Vector(df.select(*names, *bucket, TS, VALUE, *more), names, parts[0].histogram, any(p.exponential for p in parts))


def stitched(parts: list[Vector]) -> Vector:
    return stitch(parts)
