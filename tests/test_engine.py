"""Joins, set operators, aggregation, labels, histograms, errors and plans."""

import json
import math

import pytest

from tidelattice import model
from tidelattice.api import Engine
from tidelattice.functions.instant import fold
from tidelattice.model import INF, LimitError, QueryError

T = 600_000


@pytest.fixture
def e(spark):
    e = Engine(spark)
    rows = [("a", "1", 10.0), ("a", "2", 20.0), ("b", "1", 30.0), ("c", None, float("nan"))]
    e.register("m", spark.createDataFrame([(x, y, T, v) for x, y, v in rows], "x string, y string, ts long, value double"), ["x", "y"])
    e.register("n", spark.createDataFrame([("a", "east", T, 2.0), ("b", "west", T, 0.0)], "x string, zone string, ts long, value double"), ["x", "zone"])
    return e


def values(df, *labels):
    return {tuple(r[x] for x in labels): r["value"] for r in df.collect()}


def test_joins(e):
    assert values(e.query("m / on (x) group_left (zone) n", T), "x", "y", "zone") == {("a", "1", "east"): 5.0, ("a", "2", "east"): 10.0, ("b", "1", "west"): INF}
    assert "_metric_" not in e.query("m + m", T).columns and "_metric_" in e.query("m > 15", T).columns
    assert values(e.query("sum by (x) (m) > on (x) n", T), "x") == {("a",): 30.0, ("b",): 30.0}
    assert values(e.query("sum by (x) (m) == bool on (x) n", T), "x") == {("a",): 0.0, ("b",): 0.0}
    assert values(e.query("n * on (x) group_right m", T), "x", "y") == {("a", "1"): 20.0, ("a", "2"): 40.0, ("b", "1"): 0.0}


def test_several_matches_are_an_error(e):
    with pytest.raises(Exception, match="match one key"):
        e.query("m + on (x) n", T).collect()


def test_set_operators(e):
    assert values(e.query('m and on (x) n{zone="east"}', T), "x", "y") == {("a", "1"): 10.0, ("a", "2"): 20.0}
    assert values(e.query('m unless on (x) n{zone="east"}', T), "x", "y") == {("b", "1"): 30.0}
    assert len(values(e.query('m{x="a"} or m', T), "x", "y")) == 3
    assert values(e.query('n{x="a"} or on (x) m', T), "x", "y") == {("a", None): 2.0, ("b", "1"): 30.0}


def test_aggregation_skips_nan_and_keeps_absent_labels_absent(e):
    assert values(e.query("count by (x) (m)", T), "x") == {("a",): 2.0, ("b",): 1.0}
    assert values(e.query("sum by (nolabel) (m)", T)) == {(): 60.0}
    assert values(e.query("topk(1, m)", T), "x", "y") == {("b", "1"): 30.0}
    assert values(e.query('count_values("v", m)', T), "v") == {("10.0",): 1.0, ("20.0",): 1.0, ("30.0",): 1.0}
    assert values(e.query("quantile(2, m)", T)) == {(): INF}
    with pytest.raises(QueryError):
        e.query("topk(m, m)", T)


def test_pointwise_domains(e):
    assert values(e.query("ln(m - 10)", T), "x", "y")[("a", "1")] == -INF
    assert values(e.query("m / 0", T), "x", "y")[("a", "1")] == INF and values(e.query("m % 0", T), "x", "y") == {}
    assert values(e.query("-5.5 % 3 * vector(1)", T)) == {(): -2.5}
    assert values(e.query("round(m + 2.5, 5)", T), "x", "y")[("a", "1")] == 15.0
    assert values(e.query("clamp_max(m, 15)", T), "x", "y")[("b", "1")] == 15.0
    assert values(e.query('or_vector(m{x="zz"}, 7)', T)) == {(): 7.0}
    assert values(e.query("day_of_week(vector(0))", T)) == {(): 4.0} and values(e.query("days_in_month(vector(951782400))", T)) == {(): 29.0}
    assert values(e.query("scalar(n) * vector(1)", T)) == {} and values(e.query('scalar(n{x="a"}) * vector(1)', T)) == {(): 2.0}
    assert fold("%", -5.5, 3) == -2.5 and fold("/", -1, 0) == -INF and math.isnan(fold("^", -8, 0.5))


def test_labels(e):
    assert values(e.query('label_replace(m, "z", "$2/$1$9", "x", "(a)(.?)")', T), "x", "y", "z")[("a", "1", "/a")] == 10.0
    assert values(e.query('label_replace(m, "y", "", "x", "a")', T), "x", "y").keys() == {("a", None), ("b", "1")}
    assert values(e.query('label_join(m, "z", "-", "y", "x")', T), "z") == {("1-a",): 10.0, ("2-a",): 20.0, ("1-b",): 30.0}
    with pytest.raises(QueryError):
        e.query('label_replace(m, "1z", "a", "x", ".*")', T)
    assert [r["value"] for r in e.query("sort_desc(m)", T).collect()] == [30.0, 20.0, 10.0]
    assert e.query("m limit 2", T).count() == 2 and e.query("limit(1, m)", T).count() == 1
    assert values(e.query('absent(m{x="q",y=~"1"})', T), "x") == {("q",): 1.0} and e.query("absent(m)", T).count() == 0


def test_matchers(e):
    n = lambda q: e.query(q, T).count()
    assert n('m{y=""}') == 0 and n('m{y!=""}') == 3 and n('m{x=~"a|b"}') == 3 and n('m{x=~"^a$"}') == 2 and n('m{x!~"a.*"}') == 1 and n('m{x=~".+",y=~".*"}') == 3 and n('m{q=""}') == 3 and n('m{q!=""}') == 0
    with pytest.raises(QueryError):
        n('m{x=~"a$b"}')
    with pytest.raises(QueryError):
        n('m{_type_="nope"}')
    assert n('m{_type_="gauge"}') == 3 and n('m{_type_="prom-counter"}') == 0 and n("unknown") == 0


def test_histograms(spark):
    e = Engine(spark)
    h = lambda *c: ([1.0, 2.0, 4.0, INF], [float(x) for x in c])
    rows = [("a", T, 10.0, 6.0, h(0, 2, 4, 6), 0.5, 5.0), ("b", T, 10.0, 4.0, h(1, 1, 4, 4), 0.5, 3.0)]
    e.register("h", spark.createDataFrame(rows, "x string, ts long, sum double, count double, h struct<les:array<double>,counts:array<double>>, min double, max double"), ["x"], schema="otel-delta-histogram")
    assert values(e.query("histogram_quantile(0.5, h)", T), "x") == {("a",): 3.0, ("b",): pytest.approx(2 + 2 * 1 / 3)}
    assert values(e.query("histogram_quantile(0.9, h)", T), "x")[("a",)] == 4.0
    assert values(e.query("histogram_quantile(2, h)", T), "x")[("a",)] == INF
    assert values(e.query("histogram_bucket(2, sum(h))", T)) == {(): 3.0}
    assert values(e.query("histogram_fraction(0, 2, sum(h))", T)) == {(): 0.3}
    assert values(e.query("histogram_max_quantile(0.9, h)", T), "x")[("a",)] == pytest.approx(4 + (5 - 4) * 1.4 / 2)
    assert values(e.query("histogram_fraction(2, 1, sum(h))", T)) == {(): 0.0} and values(e.query("histogram_fraction(1, 3, sum(h))", T)) == {(): pytest.approx((5.5 - 1) / 10)}
    assert values(e.query('histogram_max_quantile_even(0.9, "x", h)', T), "x")[("a",)] == pytest.approx(4 + (5 - 4) * 1.4 / 3)
    assert values(e.query('hist_to_prom_vectors(h{x="a"})', T), "_metric_", "le") == {("h_bucket", "1"): 0.0, ("h_bucket", "2"): 2.0, ("h_bucket", "4"): 4.0, ("h_bucket", "+Inf"): 6.0}
    assert values(e.query('h_bucket{le="2"}', T), "x") == {("a",): 2.0, ("b",): 1.0} and values(e.query("sum(h_sum)", T)) == {(): 20.0}
    assert values(e.query("count(h)", T)) == {(): 2.0}
    with pytest.raises(QueryError):
        e.query("avg(h)", T)
    with pytest.raises(QueryError):
        e.query("min_over_time(h[5m])", T)
    assert e.query("sum(h)", T).first()["counts"] == [1.0, 3.0, 8.0, 10.0]


def test_counts_that_fall_are_raised_and_scalars_read_once(spark, e):
    falling = spark.createDataFrame([("a", "1", T, 5.0), ("a", "2", T, 3.0), ("a", "+Inf", T, 6.0)], "x string, le string, ts long, value double")
    e.register("b_bucket", falling, ["x", "le"])
    assert values(e.query("histogram_quantile(0.5, b_bucket)", T), "x") == {("a",): pytest.approx(0.6)}
    e.register("f", spark.read.parquet("/root/testdata/sf0.001/events.parquet"), ["event_type"])
    assert e.explain("scalar(sum(f))", T, T, 0).count("- Scan parquet") == 1
    e.register("far", spark.createDataFrame([("a", None, T, 1.0), (None, "a", T + 60_000_000, 2.0)], "x string, y string, ts long, value double"), ["x", "y"])
    assert e.query_range("scalar(far)", T, T + 60_000_000, 60_000_000).count() == 2
    assert [r["value"] for r in e.query_range("vector(scalar(far))", T, T + 60_000_000, 60_000_000).collect()] == []
    assert [r["value"] for r in e.query_range('vector(scalar(far{x="a"}))', T, T + 60_000_000, 60_000_000).collect()] == [1.0]


def test_exponential_buckets():
    les = model.exponential(3, -5, 20)
    assert les[0] == 0.0 and les[1] == pytest.approx(2 ** (-4 / 8)) and len(les) == 21
    a = (3, -8, [0.0] + [float(i) for i in range(1, 17)])
    b = (2, -4, [1.0] + [float(2 * i) for i in range(1, 9)])
    scale, start, counts = model.merge_exponential(a, b)
    assert scale == 2 and counts[-1] == 16 + 16 and counts == sorted(counts)
    assert model.geometric(2, 2, 4, True) == [1, 3, 7, 15]
    with pytest.raises(QueryError):
        model.exponential(21, 0, 3)


def test_schemas():
    model.validate_schemas(model.SCHEMAS)
    assert model.parse_column("h:hist:counter=true").cumulative and not model.parse_column("v:double").cumulative
    for bad in ("x", "x:nope", "h:hist", ":int"):
        with pytest.raises(QueryError):
            model.parse_column(bad)


def test_plans_prune_push_and_shuffle_once(spark):
    e = Engine(spark)
    e.register("m", spark.read.parquet("/root/testdata/sf0.001/events.parquet"), ["event_type", "user_id"])
    day = 86_400_000
    plan = e.explain('sum by (event_type) (sum_over_time(m{event_type=~"click|view"}[1d]))', 1704499200000, 1704499200000 + 5 * day, day)
    scan = plan[plan.index("PushedFilters") : plan.index("ReadSchema") + 200]
    assert "In(event_type, [click,view])" in scan and "GreaterThanOrEqual(ts" in scan and "props" not in plan
    rate = e.explain("rate(m[1d])", 1704499200000, 1704499200000 + 5 * day, day)
    assert rate.split("(1) Scan")[0].count("Exchange") == 1
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_response_and_metadata(e):
    out = json.loads(e.response(e.query('m{x="b"}', T), instant=True))
    assert out["data"]["result"] == [{"metric": {"_metric_": "m", "x": "b", "y": "1"}, "value": [600.0, "30.0"]}]
    assert {r["label"] for r in e.labels("m").collect()} == {"_metric_", "x", "y"}
    assert {r["x"] for r in e.label_values("x", "m").collect()} == {"a", "b", "c"}
    with pytest.raises(QueryError):
        e.label_values(["x", "y"], "m")
    assert e.series("m").count() == 4 and e.read("m", 0, T).count() == 4
    with pytest.raises(QueryError):
        e.query_range("m", 0, T, 1)
    e.config = model.Config(sample_limit=2)
    with pytest.raises(QueryError):
        e.checked(e.query("m", T))
    assert e.checked(e.query("sum(m)", T)).count() == 1


def test_limits(e):
    e.config = model.Config(enforce=True, join_limit=2, group_limit=1)
    for text in ("m + on (x, y) m", "m * on (x) group_left (zone) n", "sum by (x) (m)"):
        with pytest.raises(LimitError):
            e.query(text, T)
    assert e.query("sum(m)", T).count() == 1 and e.query('sum by (x) (m{x="b"})', T).count() == 1 and e.query("n + on (x, zone) n", T).count() == 2
    e.config = model.Config(enforce=True, sample_limit=2)
    with pytest.raises(LimitError):
        e.query("m", T)
    e.config = model.Config(enforce=True, scan_bytes_limit=1)
    e.register("f", e.spark.read.parquet("/root/testdata/sf0.001/events.parquet"), ["event_type"])
    with pytest.raises(LimitError, match="bytes"):
        e.query("f", T)
    assert model.Config().enforce is False and Engine(e.spark).query("vector(1)", T).count() == 1


def test_statistics(e):
    df, stats = e.with_stats("sum by (x) (m) + on (x) group_left () sum by (x) (n)", T, T, 0)
    assert df.count() == 2
    got = stats.figures()
    assert got["samples_scanned"] == 6 and got["result_samples"] == 2 and got["series_scanned"] == 6 and stats.warnings() == []
    e.config = model.Config(sample_limit=1)
    df, stats = e.with_stats("m", T, T, 0)
    df.collect()
    assert len(stats.warnings()) == 2


def test_one_series_from_two_tables_is_stitched(e):
    more = [("a", "1", T, 10.0), ("a", "2", T, 21.0), ("d", "1", T, 4.0)]
    e.register("m", e.spark.createDataFrame(more, "x string, y string, ts long, value double"), ["x", "y"])
    assert values(e.query("m * m", T), "x", "y") == {("a", "1"): 100.0, ("b", "1"): 900.0, ("d", "1"): 16.0}
    assert values(e.query("n * on (x) group_right m", T), "x", "y")[("a", "1")] == 20.0
    with pytest.raises(Exception, match="match one key"):
        e.query("m + on (x) n", T).collect()


def test_own_functions(e):
    e.function("scaled", lambda v, k, c: v * k + c, 2)
    assert values(e.query("scaled(sum(m), 2, 1)", T)) == {(): 121.0}
    for text in ("scaled(m)", "nope(m)", "scaled(1, 2, 3)"):
        with pytest.raises(QueryError):
            e.query(text, T)
    for name in ("abs", "a b"):
        with pytest.raises(QueryError):
            e.function(name, lambda v: v)


def test_extremes_of_histograms(spark):
    e = Engine(spark)
    h = lambda *c: ([1.0, 2.0, INF], [float(x) for x in c])
    rows = [("a", t, 1.0, 3.0, h(1, 2, 3), lo, hi) for t, lo, hi in ((T - 60_000, 0.1, 9.0), (T, 0.5, 5.0))] + [("b", T, 1.0, 1.0, h(0, 0, 1), 0.2, 3.0)]
    e.register("h", spark.createDataFrame(rows, "x string, ts long, sum double, count double, h struct<les:array<double>,counts:array<double>>, min double, max double"), ["x"], schema="otel-delta-histogram")
    one = e.query("sum(h)", T, extremes=True).first()
    assert (one["max"], one["min"], one["counts"]) == (5.0, 0.2, [1.0, 2.0, 4.0])  # the latest samples
    one = e.query("sum(sum_over_time(h[5m]))", T, extremes=True).first()
    assert (one["max"], one["min"], one["counts"]) == (9.0, 0.1, [2.0, 4.0, 7.0])
    far = [(r["x"], r["ts"], r["max"], r["min"]) for r in e.query_range("sum_over_time(h[5m])", T, T + 300_000, 5_000, extremes=True).collect()]
    near = [(x, t, 9.0 if x == "a" and t <= T + 240_000 else 5.0 if x == "a" else 3.0, 0.1 if x == "a" and t <= T + 240_000 else 0.5 if x == "a" else 0.2) for x in "ab" for t in range(T, T + 300_001, 5_000)]
    assert sorted(far) == near  # by panes
    out = json.loads(e.response(e.query("sum(h)", T), instant=True))
    assert out["data"]["result"] == [{"metric": {}, "value": [600.0, {"1.0": 1.0, "2.0": 2.0, "+Inf": 4.0}]}]
    e.register("plain", spark.createDataFrame([("a", T, h(1, 2, 3), 1.0, 1.0)], "x string, ts long, h struct<les:array<double>,counts:array<double>>, sum double, count double"), ["x"], schema="delta-histogram")
    with pytest.raises(QueryError):
        e.query("histogram_max_quantile(0.9, plain)", T)


def test_label_maps_become_columns(spark):
    e = Engine(spark)
    rows = [("p", {"a": "1"}, T, 1.0), ("p", {"b": "2"}, T, 2.0), ("q", {}, T, 3.0)]
    e.register_samples(spark.createDataFrame(rows, "metric string, labels map<string,string>, ts long, value double"))
    assert values(e.query("p", T), "a", "b") == {("1", None): 1.0, (None, "2"): 2.0} and values(e.query("sum(q)", T)) == {(): 3.0}


def test_sums_do_not_hang_on_the_order(spark):
    r = __import__("random").Random(9)
    cents = [round(r.uniform(-50, 500), 2) for _ in range(20000)] + [0.1] * 1000
    sums = []
    for rows in (cents, sorted(cents), sorted(cents, reverse=True)):
        e = Engine(spark)
        e.register("c", spark.createDataFrame([("a", str(i), T, v) for i, v in enumerate(rows)], "x string, i string, ts long, value double").coalesce(1), ["x", "i"])
        sums.append(values(e.query("sum by (x) (c)", T), "x")[("a",)])
    assert sums == [math.fsum(cents)] * 3


def test_sums_of_large_and_infinite_values(spark):
    # infinities of both signs and NaN have no sum
    rows = [("a", 1e300), ("a", 1.5), ("a", -1e300), ("b", INF), ("b", 0.1), ("c", INF), ("c", -INF), ("d", 2.0**40), ("d", 0.5), ("e", 1e308), ("e", 1e308), ("f", 1e-300), ("f", 2e-300), ("g", float("nan")), ("g", 0.25)]
    e = Engine(spark)
    e.register("c", spark.createDataFrame([(x, str(i), T, v) for i, (x, v) in enumerate(rows)], "x string, i string, ts long, value double"), ["x", "i"])
    got = {k[0]: v for k, v in values(e.query("sum by (x) (c)", T), "x").items()}
    assert got.pop("a") in (0.0, 1.5)
    assert got == {"b": INF, "d": 2.0**40 + 0.5, "e": INF, "f": 1e-300 + 2e-300, "g": 0.25}
