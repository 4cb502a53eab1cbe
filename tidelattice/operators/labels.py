"""Relabelling, ordering, limiting and absence."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..model import METRIC, TS, VALUE, Grid, QueryError, Vector
from ..plans.parser import Matcher
from .select import regex

_LABEL = re.compile(r"[a-zA-Z_][a-zA-Z0-9_:\-.]*")


def _set(v: Vector, name: str, value) -> Vector:
    if not _LABEL.fullmatch(name):
        raise QueryError(f"{name!r} is no label name")
    labels = v.labels if name in v.labels else (*v.labels, name)
    return Vector(v.df.withColumn(name, value), labels, v.histogram, v.exponential)


def label_replace(v: Vector, to: str, replacement: str, source: str, pattern: str) -> Vector:
    """Where the pattern matches the whole source label, set `to` to the replacement ($1 ... are groups; an empty result drops it)."""
    whole = f"(?s)\\A(?:{regex(pattern)})\\z"
    try:
        groups = re.compile(pattern).groups
    except re.error as e:
        raise QueryError(f"bad pattern {pattern!r}") from e
    text = F.coalesce(F.col(source), F.lit("")) if source in v.labels else F.lit("")
    parts = []
    at = 0
    for m in re.finditer(r"\$(?:\{(\w+)\}|(\w+))", replacement):
        parts.append(F.lit(replacement[at : m.start()]))
        name = m[1] or m[2]
        if name.isdigit() and int(name) <= groups:
            parts.append(F.regexp_extract(text, whole, int(name)))
        at = m.end()
    parts.append(F.lit(replacement[at:]))
    got = F.concat(*parts)
    old = F.col(to) if to in v.labels else F.lit(None).cast("string")
    return _set(v, to, F.when(text.rlike(whole), F.when(got != "", got)).otherwise(old))


def label_join(v: Vector, to: str, separator: str, *sources: str) -> Vector:
    parts = [F.coalesce(F.col(s), F.lit("")) if s in v.labels else F.lit("") for s in sources]
    got = F.concat_ws(separator, *parts)
    return _set(v, to, F.when(got != "", got))


def sort(v: Vector, descending: bool = False) -> Vector:
    """Series in order of their first value."""
    if v.histogram:
        raise QueryError("histograms have no order")
    first = F.min_by(VALUE, TS).over(Window.partitionBy(*v.labels))
    order = F.desc("__first") if descending else F.asc("__first")
    return v.with_df(v.df.withColumn("__first", first).orderBy(order, *v.labels, TS).drop("__first"))


def limit(v: Vector, n: int) -> Vector:
    """All rows of the first n series in label order."""
    if n < 0:
        raise QueryError("a limit is not negative")
    chosen = v.df.select(*v.labels).distinct().orderBy(*v.labels).limit(n)
    if not v.labels:
        return v if n else v.with_df(v.df.limit(0))
    keys = [f"__k{i}" for i in range(len(v.labels))]
    # nulls are labels that a series lacks: keys with a mark for them
    mark = lambda df: df.withColumns({k: F.coalesce(F.concat(F.lit("="), x), F.lit("")) for k, x in zip(keys, v.labels, strict=True)})
    return v.with_df(mark(v.df).join(mark(chosen).select(*keys), keys, "left_semi").drop(*keys))


def absent(v: Vector, grid: Grid, matchers: tuple[Matcher, ...] = ()) -> Vector:
    """1 at instants without any sample; labels are those that an equality matcher fixes."""
    names: dict[str, str | None] = {}
    for m in matchers:
        if m.op == "=" and m.label not in (METRIC, "__name__"):
            names[m.label] = m.value if m.label not in names else None
    have = v.df.filter(~F.isnan(VALUE)).select(TS).distinct()
    times = grid.frame(v.df.sparkSession).join(have, TS, "left_anti")
    fixed = {k: x for k, x in names.items() if x is not None}
    return Vector(times.select(*[F.lit(x).alias(k) for k, x in fixed.items()], TS, F.lit(1.0).alias(VALUE)), tuple(fixed))
