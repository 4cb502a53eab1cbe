"""Resampling: every sample is assigned to the grid instants whose look-back window holds it, and windows are grouped.

A sample at t belongs to the instants in [t, t + window], which is a range of grid indexes: an explode, not a join. The grouping key
is (series, instant), so a long series is spread over tasks, and sums, extremes and
counts are combined before the shuffle. Where a window spans many instants, functions whose parts can be merged go by panes instead of copies. Functions that need the preceding sample take it from one window over the series first; over a
short range its hash partitioning by series serves the grouping too, so the plan has a single exchange, and over a long
range series are cut into stretches of time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..model import TS, VALUE, Grid, QueryError, Vector

I, AT = "__i", "__at"


def assign(df: DataFrame, grid: Grid, window: int, inclusive: bool = True) -> DataFrame:
    """One row per sample and instant, with the instant's index __i and time __at."""
    if window < 0:
        raise QueryError("a window is not negative")
    start, step, n = grid.start, grid.each, grid.n
    reach = window if inclusive else window - 1
    rows = df.filter(F.col(TS).between(start - reach, start + (n - 1) * step))
    lo = F.when(F.col(TS) <= start, F.lit(0).cast("long")).otherwise(F.expr(f"({TS} - {start}L + {step - 1}L) div {step}L"))
    hi = F.least(F.lit(n - 1).cast("long"), F.expr(f"({TS} + {reach}L - {start}L) div {step}L"))
    rows = rows.withColumn("__lo", lo).withColumn("__hi", hi).filter("__lo <= __hi")
    if reach < step:
        rows = rows.withColumn(I, F.col("__lo"))  # windows do not overlap: at most one instant each
        if reach == 0 or n == 1:
            return rows.withColumn(AT, F.col(I) * step + start).drop("__lo", "__hi")
    rows = rows.withColumn(I, F.explode(F.sequence("__lo", "__hi")))
    return rows.withColumn(AT, F.col(I) * step + start).drop("__lo", "__hi")


#: From so many instants a window on, samples are combined by panes instead of being copied to every instant.
FAR = 32


def far(grid: Grid, reach: int) -> bool:
    return min(reach // grid.each, grid.n) >= FAR


def by_panes(df: DataFrame, keys: tuple[str, ...], grid: Grid, reach: int, merges: Callable, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates by series and instant (__i), at a cost that does not grow with window / step.

    A pane is the samples of a series that lie in the same windows: those of instants lo to hi, which are q or q + 1 with q = reach div step.
    Panes are cut into blocks of q instants by lo. The window of an instant in block b is then a run of panes that begins block b (lo up to
    the instant) and one that ends block b - 1 (hi from the instant on), so running aggregates in both directions hold all that is needed, and
    at most two rows meet at an instant. Nothing is subtracted, so extremes work as sums do."""
    step, q = grid.each, reach // grid.each
    shift = q + 1  # keeps indexes positive: instant i is i + shift
    at = f"({TS} - {grid.start - shift * step}L)"
    rows = df.filter(F.col(TS).between(grid.start - reach, grid.start + (grid.n - 1) * step))
    rows = rows.withColumns({"__lo": F.expr(f"({at} + {step - 1}L) div {step}L"), "__hi": F.expr(f"({at} + {reach}L) div {step}L")})
    panes = rows.groupBy(*keys, "__lo", "__hi").agg(*[c.alias(f"__p_{n}") for n, c in aggregates.items()]).withColumn("__block", F.expr(f"__lo div {q}L"))
    block = Window.partitionBy(*keys, "__block")
    onward, back = block.orderBy("__lo", "__hi"), block.orderBy(F.desc("__lo"), F.desc("__hi"))
    first = merges(lambda n: F.col(f"__p_{n}"))
    running = {f"__f_{n}": c.over(onward.rowsBetween(Window.unboundedPreceding, 0)) for n, c in first.items()}
    running |= {f"__b_{n}": c.over(back.rowsBetween(Window.unboundedPreceding, 0)) for n, c in first.items()}
    panes = panes.withColumns(running | {"__next": F.lead("__lo").over(onward), "__before": F.lag("__hi").over(onward)})
    border = (F.col("__block") + 1) * q  # first instant of the next block
    low, high = F.lit(shift), F.lit(shift + grid.n - 1)

    def instants(a: Column, z: Column, side: int) -> Column:
        a, z = F.greatest(a, low).cast("long"), F.least(z, high).cast("long")
        return F.when(a <= z, F.sequence(a * 2 + side, z * 2 + side, F.lit(2).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    begins = instants(F.col("__lo"), F.coalesce(F.col("__next"), border) - 1, 0)
    ends = instants(F.greatest(F.col("__before") + 1, border), F.col("__hi"), 1)
    rows = panes.withColumn("__is", F.explode(F.concat(begins, ends)))
    side = F.col("__is") % 2 == 0
    parts = rows.select(*keys, F.expr(f"__is div 2L - {shift}L").alias(I), *[F.when(side, F.col(f"__f_{n}")).otherwise(F.col(f"__b_{n}")).alias(f"__p_{n}") for n in first])
    return parts.groupBy(*keys, I).agg(*[c.alias(f"__a_{n}") for n, c in first.items()])


#: A series is split into stretches of so many windows, where a query covers at least two of them.
STRETCH = 16


def with_previous(v: Vector, grid: Grid, window: int) -> DataFrame:
    """Samples with the previous one of their series: __pts, __pv.

    A predecessor matters only if some window holds both samples, so a long series is cut into stretches of time, each with the last
    window of the one before it as context: one hot series is then sorted by many tasks."""
    first, size = grid.start - window, STRETCH * window
    df, keys = v.df, list(v.keys)
    split = window > 0 and grid.end - first >= 2 * size
    if split:
        own = F.expr(f"({TS} - {first}L) div {size}L")
        near_end = F.expr(f"({TS} - {first}L) % {size}L >= {size - window}L")
        df = df.filter(F.col(TS).between(first, grid.end)).withColumn("__own", own)
        df = df.withColumn("__stretch", F.explode(F.when(near_end, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
        keys.append("__stretch")
    w = Window.partitionBy(*keys).orderBy(TS)
    df = df.withColumn("__pts", F.lag(TS).over(w)).withColumn("__pv", F.lag(VALUE).over(w))
    return df.filter("__own = __stretch").drop("__own", "__stretch") if split else df


def extremes_over(v: Vector, part: Callable[[str], Column], latest: bool, at: str) -> dict[str, Column]:
    """The largest and least observation of a window's histograms, or those of the latest one."""
    out = {}
    for c in v.extremes:
        x = F.nanvl(part(c), F.lit(None).cast("double"))
        out[c] = F.max_by(x, part(at)) if latest else (F.max if c == "__max" else F.min)(x)
    return out


def resample(v: Vector, grid: Grid, window: int, function, *, offset: int = 0, inclusive: bool = True, args: tuple[float, ...] = (), counter: bool | None = None) -> Vector:
    """Apply a range function (functions.range_functions.RangeFunction) over the look-back window of every instant.

    An offset evaluates the grid earlier and reports the results at the original instants. Empty windows give no row."""
    at = grid.shifted(-offset)
    df = v.df if function.keeps_nan else v.df.filter(F.col(VALUE).isNotNull() & ~F.isnan(VALUE))
    if function.previous:
        df = with_previous(v.with_df(df), at, window)
    if function.prepare is not None:
        df = function.prepare(df)
    aggregates, reach = function.aggregates(window, args), window if inclusive else window - 1
    merges = function.merges
    if v.extremes:
        aggregates = aggregates | extremes_over(v, F.col, function.latest, TS)
        if merges is not None:
            merges = lambda p: function.merges(p) | extremes_over(v, p, function.latest, "t")
    if merges is not None and far(at, reach):
        grouped = by_panes(df, v.keys, at, reach, merges, aggregates)
    else:
        grouped = assign(df, at, window, inclusive).groupBy(*v.keys, I).agg(*[c.alias(f"__a_{n}") for n, c in aggregates.items()])
    # bounds of the window, for extrapolation
    t = F.col(I) * at.each + at.start
    bounds = {"start": t - window, "end": t, "window": window}
    for stage in function.stages(bounds) if function.stages else ():
        grouped = grouped.withColumns({f"__a_{n}": c for n, c in stage.items()})
    out = function.finish(bounds, args, counter)
    result = grouped.select(*v.keys, (t + offset).cast("long").alias(TS), out.cast("double").alias(VALUE), *[F.col(f"__a_{c}").alias(c) for c in v.extremes])
    return v.with_df(result.filter(F.col(VALUE).isNotNull() & ~F.isnan(VALUE)))


def repeat(v: Vector, grid: Grid) -> Vector:
    """A single instant's values at every instant of the grid."""
    times = F.explode(F.sequence(F.lit(grid.start), F.lit(grid.end), F.lit(grid.each)))
    return v.with_df(v.df.drop(TS).withColumn(TS, times).select(*v.keys, TS, VALUE, *v.extremes))


def stitch(parts: list[Vector], equal_within: float | None = None) -> Vector:
    """Merge vectors of the same labels; two different values at one instant are no value."""
    df = parts[0].df
    for p in parts[1:]:
        df = df.unionByName(p.df, allowMissingColumns=True)
    lo, hi = F.min(VALUE), F.max(VALUE)
    same: Column = lo == hi if equal_within is None else hi - lo <= equal_within
    v = parts[0]
    out = df.filter(~F.isnan(VALUE)).groupBy(*v.keys, TS).agg(F.when(same, lo).alias(VALUE))
    return v.with_df(out.filter(F.col(VALUE).isNotNull()))
