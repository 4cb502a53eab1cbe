"""Look-back window functions as aggregate expressions.

A function has three parts: what must be added to the samples (prepare, previous), aggregates per window, and the
result made of them. Counter drops are summed over the window and the first sample's own drop (which lies before the window) is taken
off again, so no per-window arrays are needed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import INF, NAN, TS, VALUE, QueryError, double

_AT = "__at"


@dataclass(frozen=True)
class RangeFunction:
    aggregates: Callable[[int, tuple], dict[str, Column]]
    finish: Callable[[dict, tuple, bool | None], Column]
    previous: bool = False
    keeps_nan: bool = False
    prepare: Callable[[DataFrame], DataFrame] | None = None
    histogram: bool = False
    subquery: bool = True
    #: further columns from the aggregates, a projection each, so that what is used several times is computed once
    stages: Callable[[dict], list[dict[str, Column]]] | None = None
    #: how aggregates of parts of a window become those of the window, if they can: from a part's columns by name
    merges: Callable[[Callable[[str], Column]], dict[str, Column]] | None = None
    #: takes the latest sample only; its aggregates then have that one's time as t
    latest: bool = False


def _c(name: str) -> Column:
    return F.col(name)


def _g(name: str) -> Column:
    """An aggregate of the window; labels may have any name."""
    return F.col(f"__a_{name}")


def _simple(make: Callable[[Column], Column], **more) -> RangeFunction:
    return RangeFunction(lambda w, a: {"x": make(_c(VALUE))}, lambda b, a, c: _g("x"), **more)


def _merged(make: Callable[[Column], Column], merge: Callable[[Column], Column], **more) -> RangeFunction:
    return _simple(make, merges=lambda p: {"x": merge(p("x"))}, **more)


def _last(stale: bool) -> RangeFunction:
    """The last sample; on raw data a NaN there marks the series as ended and gives nothing."""
    return RangeFunction(
        lambda w, a: {"t": F.max(TS), "x": F.max_by(VALUE, TS)},
        lambda b, a, c: _g("x"),
        keeps_nan=stale,
        histogram=True,
        merges=lambda p: {"t": F.max(p("t")), "x": F.max_by(p("x"), p("t"))},
        latest=True,
    )


def _drops(df: DataFrame) -> DataFrame:
    # a NaN sample counts as 0, as a counter that was reset
    v, p = F.nanvl(VALUE, F.lit(0.0)), F.nanvl("__pv", F.lit(0.0))
    return df.withColumn("__v", v).withColumn("__drop", F.when(_c("__pv").isNotNull() & (v < p), p).otherwise(0.0))


def _extrapolated(rate: bool, counter: bool) -> RangeFunction:
    def aggregates(w: int, a: tuple) -> dict[str, Column]:
        v = "__v" if counter else VALUE
        out = {"n": F.count("*"), "t1": F.min(TS), "t2": F.max(TS), "v1": F.min_by(v, TS), "v2": F.max_by(v, TS)}
        if counter:
            out |= {"drops": F.sum("__drop"), "drop1": F.min_by("__drop", TS)}
        return out

    def merges(p: Callable[[str], Column]) -> dict[str, Column]:
        out = {"n": F.sum(p("n")), "t1": F.min(p("t1")), "t2": F.max(p("t2")), "v1": F.min_by(p("v1"), p("t1")), "v2": F.max_by(p("v2"), p("t2"))}
        if counter:
            out |= {"drops": F.sum(p("drops")), "drop1": F.min_by(p("drop1"), p("t1"))}
        return out

    def stages(b: dict) -> list[dict[str, Column]]:
        first = {
            "span": (_g("t2") - _g("t1")) / 1000.0,
            "delta": _g("v2") - _g("v1") + (_g("drops") - _g("drop1") if counter else 0.0),
            "to_start": (_g("t1") - b["start"]) / 1000.0,
            "to_end": (b["end"] - _g("t2")) / 1000.0,
        }
        second = {"mean": _g("span") / (_g("n") - 1)}
        if counter:  # a counter cannot have been below zero
            zero = F.when((_g("delta") > 0) & (_g("v1") >= 0), _g("span") * _g("v1") / F.when(_g("delta") != 0, _g("delta")))
            second["to_start"] = F.least(_g("to_start"), zero)  # of those that are not null
        return [first, second]

    def finish(b: dict, a: tuple, c: bool | None) -> Column:
        near, half = _g("mean") * 1.1, _g("mean") / 2
        reach = _g("span") + F.when(_g("to_start") < near, _g("to_start")).otherwise(half) + F.when(_g("to_end") < near, _g("to_end")).otherwise(half)
        got = _g("delta") * reach / _g("span")
        if rate:
            got = got / b["window"] * 1000.0 if b["window"] else got
        return F.when((_g("n") > 1) & (_g("t2") > _g("t1")), got)

    return RangeFunction(aggregates, finish, previous=counter, keeps_nan=counter, prepare=_drops if counter else None, histogram=True, stages=stages, merges=merges)


def _delta_rate() -> RangeFunction:
    return RangeFunction(lambda w, a: {"x": F.sum(VALUE)}, lambda b, a, c: _g("x") / b["window"] * 1000.0, histogram=True, merges=lambda p: {"x": F.sum(p("x"))})


def _mean() -> RangeFunction:
    return RangeFunction(lambda w, a: {"s": F.sum(VALUE), "n": F.count(VALUE)}, lambda b, a, c: _g("s") / _g("n"), histogram=True, merges=lambda p: {"s": F.sum(p("s")), "n": F.sum(p("n"))})


def _last_two(finish: Callable[[dict], Column], histogram: bool = False) -> RangeFunction:
    """Functions of the last two samples; the previous one must lie in the window."""

    def pair() -> Column:
        return F.struct(_c(TS).alias("t"), _c(VALUE).alias("v"), _c("__pts").alias("pt"), _c("__pv").alias("pv"))

    return RangeFunction(lambda w, a: {"p": F.max_by(pair(), TS), "first": F.min(TS)}, lambda b, a, c: F.when(_g("p.pt") >= _g("first"), finish(b)), previous=True, histogram=histogram)


def _irate(b: dict) -> Column:
    gap = (_g("p.t") - _g("p.pt")) / 1000.0
    return F.when(gap != 0, F.when(_g("p.v") < _g("p.pv"), _g("p.v")).otherwise(_g("p.v") - _g("p.pv")) / gap)


def _irate_delta(alone: int) -> RangeFunction:
    def pair() -> Column:
        return F.struct(_c(TS).alias("t"), _c(VALUE).alias("v"), _c("__pts").alias("pt"))

    def finish(b: dict, a: tuple, c: bool | None) -> Column:
        gap = F.when(_g("p.pt") >= _g("first"), _g("p.t") - _g("p.pt")).otherwise(F.lit(alone))
        return F.when(gap != 0, _g("p.v") / gap * 1000.0)

    return RangeFunction(lambda w, a: {"p": F.max_by(pair(), TS), "first": F.min(TS)}, finish, previous=True, histogram=True)


def _steps(test: Callable[[Column, Column], Column]) -> RangeFunction:
    """How often test(previous, value) holds between consecutive samples of the window; not across a NaN."""

    def prepare(df: DataFrame) -> DataFrame:
        real = _c("__pv").isNotNull() & ~F.isnan("__pv") & ~F.isnan(VALUE)
        return df.withColumn("__step", F.when(real & test(_c("__pv"), _c(VALUE)), 1.0).otherwise(0.0))

    return RangeFunction(
        lambda w, a: {"t1": F.min(TS), "all": F.sum("__step"), "step1": F.min_by("__step", TS)},
        lambda b, a, c: _g("all") - _g("step1"),
        previous=True,
        keeps_nan=True,
        prepare=prepare,
        merges=lambda p: {"t1": F.min(p("t1")), "all": F.sum(p("all")), "step1": F.min_by(p("step1"), p("t1"))},
    )


def _seconds() -> Column:
    """Time of the sample relative to the window's end, in seconds."""
    return (_c(TS) - _c(_AT)) / 1000.0


def _regression(predict: bool) -> RangeFunction:
    def aggregates(w: int, a: tuple) -> dict[str, Column]:
        out = {"slope": F.regr_slope(VALUE, _seconds()), "n": F.count("*")}
        if predict:
            out["intercept"] = F.regr_intercept(VALUE, _seconds())
        return out

    return RangeFunction(aggregates, lambda b, a, c: F.when(_g("n") > 1, _g("slope") * a[0] + _g("intercept") if predict else _g("slope")))


def quantile_bounds(q: float, inside: Column) -> Column:
    if q != q:
        return double(NAN)
    return double(-INF) if q < 0 else double(INF) if q > 1 else inside


def _quantile() -> RangeFunction:
    return RangeFunction(lambda w, a: {"x": F.percentile(VALUE, float(min(1.0, max(0.0, a[0] if a[0] == a[0] else 0.0))))}, lambda b, a, c: quantile_bounds(a[0], _g("x")))


def _middle(sorted_values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(sorted_values)
    return (F.get(sorted_values, ((n - 1) / 2).cast("int")) + F.get(sorted_values, (n / 2).cast("int"))) / 2.0


def _deviations(w: int, a: tuple) -> dict[str, Column]:
    return {"mid": F.percentile(VALUE, 0.5), "all": F.collect_list(VALUE), "last": F.max_by(VALUE, TS)}


def _mad_of() -> Column:
    return _middle(F.array_sort(F.transform(_g("all"), lambda v: F.abs(v - _g("mid")))))


def _mad() -> RangeFunction:
    return RangeFunction(_deviations, lambda b, a, c: _mad_of())


def _outlier() -> RangeFunction:
    """Arguments: tolerance, and bounds 0 (lower), 1 (both) or 2 (upper)."""

    def finish(b: dict, a: tuple, c: bool | None) -> Column:
        tolerance, bounds = a
        mad = _mad_of()
        if tolerance <= 0 or bounds not in (0, 1, 2):
            raise QueryError("an outlier test needs a tolerance over 0 and bounds 0, 1 or 2")
        low, high = _g("last") < _g("mid") - mad * tolerance, _g("last") > _g("mid") + mad * tolerance
        return F.when((low, low | high, high)[int(bounds)], _g("last"))

    return RangeFunction(_deviations, finish)


def _holt_winters() -> RangeFunction:
    def finish(b: dict, a: tuple, c: bool | None) -> Column:
        sf, tf = a
        if not (0 < sf < 1 and 0 < tf < 1):
            raise QueryError("smoothing factors lie between 0 and 1")
        xs = F.transform(F.array_sort(_g("all")), lambda p: p["v"])
        first, second = F.get(xs, F.lit(0)), F.get(xs, F.lit(1))
        start = F.struct(first.alias("s"), (second - first).alias("b"))

        def step(state: Column, x: Column) -> Column:
            s = x * sf + (state["s"] + state["b"]) * (1 - sf)
            return F.struct(s.alias("s"), ((s - state["s"]) * tf + state["b"] * (1 - tf)).alias("b"))

        return F.when(F.size(xs) > 1, F.aggregate(F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), start, step)["s"])

    return RangeFunction(lambda w, a: {"all": F.collect_list(F.struct(_c(TS).alias("t"), _c(VALUE).alias("v")))}, finish, subquery=False)


RANGE: dict[str, RangeFunction] = {
    "last": _last(True),
    "last_over_time": _last(True),
    "last_of_results": _last(False),
    "rate": _extrapolated(True, True),
    "increase": _extrapolated(False, True),
    "delta": _extrapolated(False, False),
    "rate_of_deltas": _delta_rate(),
    "increase_of_deltas": _merged(F.sum, F.sum, histogram=True),
    "irate": _last_two(_irate, True),
    # fixed values: milliseconds that a single sample is taken to span
    "irate_of_deltas": _irate_delta(60),
    "irate_of_histogram_deltas": _irate_delta(60_000),
    "idelta": _last_two(lambda b: _g("p.v") - _g("p.pv")),
    "deriv": _regression(False),
    "predict_linear": _regression(True),
    "resets": _steps(lambda p, v: v < p),
    "changes": _steps(lambda p, v: v != p),
    "sum_over_time": _merged(F.sum, F.sum, histogram=True),
    "avg_over_time": _mean(),
    "count_over_time": _merged(lambda v: F.count(v).cast("double"), F.sum),
    "min_over_time": _merged(F.min, F.min),
    "max_over_time": _merged(F.max, F.max),
    "stddev_over_time": _simple(F.stddev_pop),
    "stdvar_over_time": _simple(F.var_pop),
    "quantile_over_time": _quantile(),
    "mad_over_time": _mad(),
    "last_over_time_is_mad_outlier": _outlier(),
    "z_score": RangeFunction(lambda w, a: {"last": F.max_by(VALUE, TS), "mean": F.avg(VALUE), "sd": F.stddev_pop(VALUE)}, lambda b, a, c: F.when(_g("sd") != 0, (_g("last") - _g("mean")) / F.when(_g("sd") != 0, _g("sd"))), subquery=False),
    "holt_winters": _holt_winters(),
    "timestamp": RangeFunction(lambda w, a: {"x": F.max(TS)}, lambda b, a, c: _g("x") / 1000.0, merges=lambda p: {"x": F.max(p("x"))}),
    "present_over_time": _merged(lambda v: F.max(F.lit(1.0)), F.max, subquery=False),
}
