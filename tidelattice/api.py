"""The engine: register tables, then query them by text or through the operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import INF, SCHEMAS, TS, VALUE, Config, Grid, LimitError, MetricTable, QueryError, Vector, expand_labels, validate_schemas
from .limits import Stats, enforce
from .operators import metadata
from .operators.histogram import collect
from .plans.compile import Compiler, Scalar
from .plans.parser import FUNCTIONS, Matcher, Node, Selector, parse, show
from .plans.rewrite import AggregationRule


class Engine:
    """Metrics by name, and queries over them. All results are lazy DataFrames: label columns, ts (epoch ms), value."""

    def __init__(self, spark: SparkSession, config: Config | None = None):
        validate_schemas(SCHEMAS)
        self.spark, self.config = spark, config or Config()
        self.tables: dict[str, list[MetricTable]] = {}
        self.rules: list[AggregationRule] = []
        self.functions: dict[str, tuple[str, Callable[..., Column]]] = {}
        if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC"):
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    def register(self, metric: str, df: DataFrame, labels: Iterable[str], time: str = TS, schema: str = "gauge", **columns: str) -> MetricTable:
        """A table of one metric. columns: the table's names for the schema's columns. Label columns become strings."""
        if schema not in SCHEMAS:
            raise QueryError(f"no schema {schema}")
        labels = tuple(labels)
        df = df.withColumns({x: F.col(x).cast("string") for x in labels if df.schema[x].dataType.simpleString() != "string"})
        table = MetricTable(metric, df, labels, time, schema, columns)
        missing = [c.name for c in SCHEMAS[schema].columns if table.source(c.name) not in df.columns]
        if SCHEMAS[schema].value_column in missing:
            raise QueryError(f"{metric} has no column {SCHEMAS[schema].value_column}")
        self.tables.setdefault(metric, []).append(table)
        return table

    def register_samples(self, df: DataFrame, schema: str = "gauge", metric: str = "metric", labels: str = "labels", label_names: Iterable[str] | None = None) -> None:
        """A table of many metrics with a map of labels; the metric stays a partition-prunable predicate."""
        wide, names = expand_labels(df, labels, label_names)
        for m in [r[0] for r in df.select(metric).distinct().collect()]:
            self.register(m, wide.filter(F.col(metric) == m), names, schema=schema)

    def register_store(self, path: str) -> None:
        """Every metric of a store that sources.store has written. Metrics and days are folders, so other ones are not read."""
        from .sources import store

        for table in store.tables(self.spark, path):
            self.tables.setdefault(table.name, []).append(table)

    def rule(self, metric: str, aggregated: str, kept: Iterable[str]) -> None:
        """`aggregated` holds `metric` summed to the kept labels; used within optimize_with_agg()."""
        self.rules.append(AggregationRule(metric, aggregated, frozenset(kept)))

    def function(self, name: str, of: Callable[..., Column], numbers: int = 0) -> None:
        """A pointwise function for queries: of(value column, one column for each number) gives a column. Built-in names cannot be taken."""
        name = name.lower()
        if name in FUNCTIONS or not name.isidentifier():
            raise QueryError(f"{name} is built in, or no name")
        self.functions[name] = ("v" + "s" * numbers, of)

    def compiler(self, extremes: bool = False, stats: Stats | None = None) -> Compiler:
        return Compiler(self.spark, self.tables, self.config, self.rules, {n: f for n, (_, f) in self.functions.items()}, extremes, stats)

    def parse(self, text: str) -> Node:
        return parse(text, self.config, {n: kinds for n, (kinds, _) in self.functions.items()})

    def evaluate(self, text: str | Node, start: int, step: int, end: int, compiler: Compiler | None = None) -> Vector | Scalar:
        if step and step < self.config.min_step_ms:
            raise QueryError(f"the step is at least {self.config.min_step_ms} ms")
        node = self.parse(text) if isinstance(text, str) else text
        return (compiler or self.compiler()).run(node, Grid(start, step, end))

    def _answer(self, text: str | Node, start: int, step: int, end: int, extremes: bool, stats: Stats | None = None) -> DataFrame:
        compiler = self.compiler(extremes, stats)
        df = self._rows(self.evaluate(text, start, step, end, compiler), Grid(start, step, end))
        return enforce(df, compiler.probes, self.config) if self.config.enforce and stats is None else df

    def query_range(self, text: str | Node, start: int, end: int, step: int, extremes: bool = False) -> DataFrame:
        """Results at start, start + step, ... end (epoch ms). extremes: histograms come with the columns max and min, where their schema has them."""
        return self._answer(text, start, step, end, extremes)

    def query(self, text: str | Node, time: int, extremes: bool = False) -> DataFrame:
        """Results at one instant; a range selector or subquery gives its samples."""
        return self._answer(text, time, 0, time, extremes)

    def with_stats(self, text: str | Node, start: int, end: int, step: int) -> tuple[DataFrame, Stats]:
        """The result and its figures, which are there after an action on it. Limits are reported as warnings, not enforced."""
        stats = Stats(self.config)
        return stats.returning(self._answer(text, start, step, end, False, stats)), stats

    def checked(self, df: DataFrame) -> DataFrame:
        """The result, or an error if it has more rows than a client should get. This runs the query up to the limit."""
        if df.limit(self.config.sample_limit + 1).count() > self.config.sample_limit:
            raise LimitError(f"the result has more than {self.config.sample_limit} samples")
        return df

    def _rows(self, got: Vector | Scalar, grid: Grid) -> DataFrame:
        if isinstance(got, Scalar):
            return self.compiler().frame(got.value, grid)
        if got.histogram:
            return collect(got)
        return got.df.filter(~F.isnan(VALUE)) if VALUE in got.df.columns else got.df

    def explain(self, text: str, start: int, end: int, step: int) -> str:
        """The query as understood, and Spark's formatted plan."""
        df = self.query_range(text, start, end, step)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return show(self.compiler().prepared(self.parse(text))) + "\n" + plan

    def _selected(self, text: str) -> tuple[MetricTable, tuple[Matcher, ...]]:
        node = self.parse(text)
        if not isinstance(node, Selector):
            raise QueryError("a selector is needed")
        found = self.compiler().matched(node)
        if not found:
            raise QueryError(f"no metric {node.metric}")
        return found[0][0], found[0][1].matchers

    def labels(self, selector: str, start: int | None = None, end: int | None = None) -> DataFrame:
        return metadata.label_names(*self._selected(selector), start, end)

    def label_values(self, names: str | Iterable[str], selector: str, start: int | None = None, end: int | None = None) -> DataFrame:
        table, matchers = self._selected(selector)
        return metadata.label_values(table, [names] if isinstance(names, str) else names, matchers, start, end)

    def series(self, selector: str, start: int | None = None, end: int | None = None, times: bool = False) -> DataFrame:
        table, matchers = self._selected(selector)
        return metadata.series_keys(table, matchers, start, end, times)

    def read(self, selector: str, start: int, end: int) -> DataFrame:
        """Raw samples, as a remote reader wants them."""
        table, matchers = self._selected(selector)
        from .operators.select import raw

        v = raw(table, matchers, start, end)
        return v.df

    def response(self, df: DataFrame, instant: bool = False) -> str:
        """A result as JSON: NaN left out, times in seconds; a histogram is an object of counts by bound. For results that a client can hold; rows are streamed."""
        histogram = "counts" in df.columns
        labels = [c for c in df.columns if c not in (TS, VALUE, "les", "counts", "max", "min")] if histogram else [c for c in df.columns if c not in (TS, VALUE)]
        series: dict[tuple, list] = {}
        for r in df.orderBy(*labels, TS).toLocalIterator():
            if histogram:
                if r["les"]:
                    counts = {"+Inf" if le == INF else repr(le): n for le, n in zip(r["les"], r["counts"], strict=True)}
                    series.setdefault(tuple(r[c] for c in labels), []).append([r[TS] / 1000, counts])
            elif r[VALUE] == r[VALUE]:
                series.setdefault(tuple(r[c] for c in labels), []).append([r[TS] / 1000, repr(r[VALUE])])
        out = [{"metric": {c: v for c, v in zip(labels, k, strict=True) if v is not None}, **({"value": s[-1]} if instant else {"values": s})} for k, s in series.items()]
        return json.dumps({"status": "success", "data": {"resultType": "vector" if instant else "matrix", "result": out}})
