"""Look-back functions against a plain Python evaluator, on irregular random series with gaps, resets and stale markers."""

import math
import random
import statistics

import pytest

from tidelattice.api import Engine
from tidelattice.model import Config, QueryError

START, STEP, END = 600_000, 60_000, 1_500_000
NAN = float("nan")


def make(seed: int, counter: bool, nan: bool) -> list[tuple[int, float]]:
    r = random.Random(seed)
    out, t, v = [], r.randrange(0, 50_000), 0.0
    while t < 1_600_000:
        v = (0.0 if r.random() < 0.05 else v + r.randrange(0, 20)) if counter else r.uniform(-50, 50)
        out.append((t, NAN if nan and r.random() < 0.1 else v))
        t += r.choice((10_000, 10_000, 15_000, 200_000 if r.random() < 0.05 else 10_000))
    return out


def extrapolate(x, ws, we, counter, rate):
    x = [(t, 0.0 if v != v else v) for t, v in x] if counter else [p for p in x if p[1] == p[1]]
    if len(x) < 2:
        return None
    (t1, v1), (t2, v2) = x[0], x[-1]
    d = v2 - v1 + (sum(a for (_, a), (_, b) in zip(x, x[1:], strict=False) if b < a) if counter else 0)
    span = (t2 - t1) / 1000
    mean = span / (len(x) - 1)
    a, z = (t1 - ws) / 1000, (we - t2) / 1000
    if counter and d > 0 and v1 >= 0:
        a = min(a, span * v1 / d)
    reach = span + (a if a < 1.1 * mean else mean / 2) + (z if z < 1.1 * mean else mean / 2)
    return d * reach / span / ((we - ws) / 1000 if rate else 1)


def holt(xs, sf, tf):
    if len(xs) < 2:
        return None
    s, b = xs[0], xs[1] - xs[0]
    for x in xs[1:]:
        new = sf * x + (1 - sf) * (s + b)
        s, b = new, tf * (new - s) + (1 - tf) * b
    return s


def line(x, we):
    p = [((t - we) / 1000, v) for t, v in x]
    mx, my = statistics.fmean(a for a, _ in p), statistics.fmean(b for _, b in p)
    d = sum((a - mx) ** 2 for a, _ in p)
    slope = sum((a - mx) * (b - my) for a, b in p) / d
    return slope, my - slope * mx


def quantile(v, q):
    v = sorted(v)
    k = q * (len(v) - 1)
    lo = math.floor(k)
    return v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (k - lo)


def mad(v):
    m = statistics.median(v)
    return statistics.median(abs(x - m) for x in v)


def pairs(x):
    return list(zip(x, x[1:], strict=False))


VALUES = {
    "sum_over_time": lambda v: sum(v),
    "avg_over_time": statistics.fmean,
    "min_over_time": min,
    "max_over_time": max,
    "count_over_time": lambda v: float(len(v)),
    "stddev_over_time": statistics.pstdev,
    "stdvar_over_time": statistics.pvariance,
    "present_over_time": lambda v: 1.0,
    "mad_over_time": mad,
    "z_score": lambda v: (v[-1] - statistics.fmean(v)) / statistics.pstdev(v) if statistics.pstdev(v) else None,
    "idelta": lambda v: v[-1] - v[-2] if len(v) > 1 else None,
}
WITH_ARGS = {
    "quantile_over_time(0.3, m[W])": lambda x, ws, we: quantile([v for _, v in x], 0.3),
    "quantile_over_time(2, m[W])": lambda x, ws, we: math.inf,
    "quantile_over_time(-1, m[W])": lambda x, ws, we: -math.inf,
    "holt_winters(m[W], 0.3, 0.7)": lambda x, ws, we: holt([v for _, v in x], 0.3, 0.7),
    "deriv(m[W])": lambda x, ws, we: line(x, we)[0] if len(x) > 1 else None,
    "predict_linear(m[W], 60)": lambda x, ws, we: line(x, we)[0] * 60 + line(x, we)[1] if len(x) > 1 else None,
    "last_over_time_is_mad_outlier(1, 1, m[W])": lambda x, ws, we: x[-1][1] if abs(x[-1][1] - statistics.median(v for _, v in x)) > mad([v for _, v in x]) else None,
    "last_over_time_is_mad_outlier(1, 2, m[W])": lambda x, ws, we: x[-1][1] if x[-1][1] > statistics.median(v for _, v in x) + mad([v for _, v in x]) else None,
    "delta(m[W])": lambda x, ws, we: extrapolate(x, ws, we, False, False),
}
COUNTERS = {
    "rate(m[W])": lambda x, ws, we: extrapolate(x, ws, we, True, True),
    "increase(m[W])": lambda x, ws, we: extrapolate(x, ws, we, True, False),
}


def check(spark, schema, column, query, window, want, nan, keep_nan=False, config=None):
    data = {f"s{k}": make(k, schema != "gauge", nan) for k in range(4)}
    e = Engine(spark, config)
    df = spark.createDataFrame([(s, t, v) for s, x in data.items() for t, v in x], f"s string, ts long, {column} double")
    e.register("m", df, ["s"], schema=schema)
    got = {(r["s"], r["ts"]): r["value"] for r in e.query_range(query.replace("W", f"{window // 1000}s"), START, END, STEP).collect()}
    expected = {}
    for s, x in data.items():
        for t in range(START, END + 1, STEP):
            inside = [(a, v) for a, v in x if t - window <= a <= t and (keep_nan or v == v)]
            if inside and (y := want(inside, t - window, t)) is not None and y == y:
                expected[s, t] = y
    assert got.keys() == expected.keys()
    for k, y in expected.items():
        assert got[k] == pytest.approx(y, rel=1e-9, abs=1e-7), k


@pytest.mark.parametrize("window", [45_000, 300_000])
@pytest.mark.parametrize("name", VALUES)
def test_of_values(spark, name, window):
    check(spark, "gauge", "value", f"{name}(m[W])", window, lambda x, ws, we: VALUES[name]([v for _, v in x]), True)


@pytest.mark.parametrize("query", WITH_ARGS)
def test_with_arguments(spark, query):
    check(spark, "gauge", "value", query, 300_000, WITH_ARGS[query], True)


@pytest.mark.parametrize("query", COUNTERS)
@pytest.mark.parametrize("nan", [False, True])
def test_counters(spark, query, nan):
    check(spark, "prom-counter", "count", query, 300_000, COUNTERS[query], nan, keep_nan=True)


@pytest.mark.parametrize("window", [45_000, 300_000])
def test_steps_are_not_counted_across_nan(spark, window):
    real = lambda x: [(a, b) for (_, a), (_, b) in pairs(x) if a == a and b == b]
    check(spark, "gauge", "value", "changes(m[W])", window, lambda x, ws, we: float(sum(a != b for a, b in real(x))), True, keep_nan=True)
    check(spark, "gauge", "value", "resets(m[W])", window, lambda x, ws, we: float(sum(b < a for a, b in real(x))), True, keep_nan=True)


def test_last_ends_at_a_stale_marker(spark):
    check(spark, "gauge", "value", "last_over_time(m[W])", 100_000, lambda x, ws, we: x[-1][1], True, keep_nan=True)


def test_deltas(spark):
    check(spark, "delta-counter", "count", "rate(m[W])", 300_000, lambda x, ws, we: sum(v for _, v in x) / 300, True)
    check(spark, "delta-counter", "count", "increase(m[W])", 300_000, lambda x, ws, we: sum(v for _, v in x), True)


def test_instant_rates(spark):
    def irate(x, ws, we):
        if len(x) < 2:
            return None
        (t1, a), (t2, b) = x[-2:]
        return (b if b < a else b - a) / ((t2 - t1) / 1000)

    check(spark, "prom-counter", "count", "irate(m[W])", 300_000, irate, False)
    check(spark, "delta-counter", "count", "irate(m[W])", 45_000, lambda x, ws, we: x[-1][1] / (x[-1][0] - x[-2][0] if len(x) > 1 else 60) * 1000, False)


@pytest.mark.parametrize("query", [*COUNTERS, "irate(m[W])"])
def test_stretches_change_nothing(spark, query, monkeypatch):
    from tidelattice.operators import grid

    e = Engine(spark)
    rows = [(f"s{k}", t, v) for k in range(3) for t, v in make(k, True, k == 1)]
    e.register("m", spark.createDataFrame(rows, "s string, ts long, count double"), ["s"], schema="prom-counter")
    results = []
    for stretch in (10**6, 2):
        monkeypatch.setattr(grid, "STRETCH", stretch)
        df = e.query_range(query.replace("W", "30s"), START, END, 10_000)
        assert ("__stretch" in df._jdf.queryExecution().optimizedPlan().toString()) == (stretch == 2)
        results.append(sorted(map(str, df.collect())))
    assert results[0] == results[1] and results[0]


MERGED = ["sum_over_time", "avg_over_time", "count_over_time", "min_over_time", "max_over_time"]


@pytest.mark.parametrize("window", [60_000, 100_000, 300_000, 530_000, 1_200_000])
def test_panes_change_nothing(spark, window, monkeypatch):
    """With panes from one instant on, whatever the window's remainder by the step, and beyond the whole range."""
    from tidelattice.operators import grid

    monkeypatch.setattr(grid, "FAR", 1)
    used, plain = [], grid.by_panes
    monkeypatch.setattr(grid, "by_panes", lambda *a: used.append(1) or plain(*a))
    for name in MERGED:
        check(spark, "gauge", "value", f"{name}(m[W])", window, lambda x, ws, we, name=name: VALUES[name]([v for _, v in x]), True)
    real = lambda x: [(a, b) for (_, a), (_, b) in pairs(x) if a == a and b == b]
    check(spark, "gauge", "value", "changes(m[W])", window, lambda x, ws, we: float(sum(a != b for a, b in real(x))), True, keep_nan=True)
    check(spark, "gauge", "value", "last_over_time(m[W])", window, lambda x, ws, we: x[-1][1], True, keep_nan=True)
    check(spark, "gauge", "value", "delta(m[W])", window, lambda x, ws, we: extrapolate(x, ws, we, False, False), True)
    for query in COUNTERS:
        check(spark, "prom-counter", "count", query, window, COUNTERS[query], True, keep_nan=True)
    assert len(used) >= len(MERGED) + 4


def test_open_windows(spark):
    data = [("a", 0, 1.0), ("a", 60_000, 2.0)]
    e = Engine(spark, Config(inclusive_range=False))
    e.register("m", spark.createDataFrame(data, "s string, ts long, value double"), ["s"])
    assert [r["value"] for r in e.query("sum_over_time(m[1m])", 60_000).collect()] == [2.0]
    e = Engine(spark)
    e.register("m", spark.createDataFrame(data, "s string, ts long, value double"), ["s"])
    assert [r["value"] for r in e.query("sum_over_time(m[1m])", 60_000).collect()] == [3.0]
    # the sample exactly as old as the staleness still counts
    assert e.query("m", 60_000 + 300_000).count() == 1 and e.query("m", 60_000 + 300_002).count() == 0


def test_subqueries_take_results_not_raw_samples(spark):
    e = Engine(spark)
    e.register("m", spark.createDataFrame([("a", t * 60_000, float(t)) for t in range(60)], "s string, ts long, value double"), ["s"])
    got = e.query("max_over_time(sum(m)[10m:3m])", 50 * 60_000).collect()
    assert [r["value"] for r in got] == [48.0]  # inner instants are multiples of the step
    assert e.query("sum(m)[10m:3m]", 50 * 60_000).count() == 3
    with pytest.raises(QueryError):
        e.query("holt_winters(m[10m:1m], 0.5, 0.5)", 0)
    with pytest.raises(QueryError):
        e.query_range("m[5m]", 0, 60_000, 60_000)


def test_at_repeats_one_instant(spark):
    e = Engine(spark)
    e.register("m", spark.createDataFrame([("a", t * 60_000, float(t)) for t in range(60)], "s string, ts long, value double"), ["s"])
    assert {r["value"] for r in e.query_range("sum_over_time(m[2m] @ start())", 600_000, 1_200_000, 60_000).collect()} == {27.0}
    assert e.query_range("m @ 300", 600_000, 1_200_000, 60_000).count() == 11
    assert {r["value"] for r in e.query_range("m[5i]", 600_000, 600_000, 60_000).collect()} >= {10.0}
