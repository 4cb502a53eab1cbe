"""Queries of the engine over the test tables, and DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Engine
from .functions.computed import computed
from .model import INF, TS, VALUE, MetricTable
from .operators import downsample as ds
from .operators import metadata
from .operators.select import drop_out_of_order, raw
from .plans.parser import Matcher

DAY = 86_400_000
T0 = 1_704_067_200_000  # 2024-01-01
START, END = T0 + 5 * DAY, T0 + 29 * DAY
LES = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, INF)
OT0, OT1 = 852_076_800_000, 852_076_800_000 + 360 * DAY  # 1997-01-01 and a year on


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """All metrics that the queries use. Nothing is read until a query runs."""
    from pyspark.sql import Window

    e = Engine(spark)
    events = read(spark, sf_dir, "events")
    e.register("events_value", events, ["event_type", "user_id"])
    key = ["event_type", "user_id"]
    n = F.row_number().over(Window.partitionBy(*key).orderBy("ts", "event_id"))
    counted = events.select(*key, "ts", n.alias("n"))
    e.register("events_total", counted.withColumn("count", F.col("n").cast("double")), key, schema="prom-counter")
    e.register("events_resets", counted.withColumn("count", (F.col("n") % 7).cast("double")), key, schema="prom-counter")
    e.register("events_delta", events, key, schema="delta-counter", count="value")
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("value"))
    e.register("order_price", orders, ["status", "priority"])
    ship = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("ts")).agg(F.sum("l_quantity").alias("value"))
    e.register("ship_qty", ship, ["flag", "status"])
    hour = F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    cells = [F.count_if(F.col("value") <= x).cast("double") for x in LES]
    hist = events.groupBy("event_type", hour.alias("ts")).agg(F.array(*cells).alias("counts"), F.sum("value").alias("sum"), F.count("*").cast("double").alias("count"), F.max("value").alias("max"), F.min("value").alias("min"))
    h = F.struct(F.array(*[F.lit(x) for x in LES]).alias("les"), F.col("counts").alias("counts"))
    e.register("latency", hist.withColumn("h", h), ["event_type"], schema="otel-delta-histogram")
    series = hist.select("event_type", "ts", F.explode(F.arrays_zip(F.array(*[F.lit("+Inf" if x == INF else f"{x:g}") for x in LES]).alias("le"), F.col("counts").alias("value"))).alias("b")).select("event_type", "ts", "b.*")
    e.register("lat_bucket", series, ["event_type", "le"])
    return e


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn(VALUE, F.round(F.col(VALUE) + 1e-7, 5)) if VALUE in df.columns else df


def _text(query: str, start: int = START, end: int = END, step: int = DAY) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: rounded(engine(spark, d).query_range(query, start, end, step))


_EV = "s AS (SELECT 'events_value' AS _metric_, event_type, CAST(user_id AS VARCHAR) AS user_id, (epoch_us(ts) // 1000) AS t, value AS v FROM events)"
_N = "row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id)"
_TOTAL = f"s AS (SELECT 'events_total' AS _metric_, event_type, CAST(user_id AS VARCHAR) AS user_id, (epoch_us(ts) // 1000) AS t, CAST({_N} AS DOUBLE) AS v FROM events)"
_RESETS = f"s AS (SELECT 'events_resets' AS _metric_, event_type, CAST(user_id AS VARCHAR) AS user_id, (epoch_us(ts) // 1000) AS t, CAST({_N} % 7 AS DOUBLE) AS v FROM events)"
_DELTA = _EV.replace("events_value", "events_delta")
_ORD = "s AS (SELECT 'order_price' AS _metric_, o_orderstatus AS status, o_orderpriority AS priority, (epoch_us(o_orderdate) // 1000) AS t, sum(o_totalprice) AS v FROM orders GROUP BY ALL)"
_SHIP = "s AS (SELECT 'ship_qty' AS _metric_, l_returnflag AS flag, l_linestatus AS status, (epoch_us(l_shipdate) // 1000) AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"
_CASES = ", ".join(f"struct_pack(le := {'1e999' if x == INF else x}::DOUBLE, name := '{'+Inf' if x == INF else f'{x:g}'}')" for x in LES)
_HIST = f"""h AS (SELECT event_type, (epoch_us(date_trunc('hour', ts)) // 1000) AS t, value FROM events),
 bounds AS (SELECT unnest([{_CASES}]) AS b),
 s AS (SELECT event_type, b.le AS bound, b.name AS le, t, CAST(count(*) FILTER (value <= b.le) AS DOUBLE) AS v FROM h, bounds GROUP BY ALL)"""
_K = "_metric_, event_type, user_id"


def _g(start: int = START, end: int = END, step: int = DAY) -> str:
    return f"g AS (SELECT unnest(generate_series({start}::BIGINT, {end}::BIGINT, {step}::BIGINT)) AS ts)"


def _win(window: int, offset: int = 0, cond: str = "true") -> str:
    return f"w AS (SELECT s.*, g.ts FROM s JOIN g ON s.t BETWEEN g.ts - {offset} - {window} AND g.ts - {offset} WHERE {cond})"


def _r(x: str) -> str:
    return f"round({x} + 1e-7, 5) AS value"


def _over(source: str, keys: str, value: str, window: int, grid: str | None = None, offset: int = 0, cond: str = "true", having: str = "true") -> str:
    return f"WITH {source}, {grid or _g()}, {_win(window, offset, cond)} SELECT {keys}, ts, {_r(value)} FROM w GROUP BY {keys}, ts HAVING {having}"


W3 = 3 * DAY
#: Instant selectors look back five minutes and a millisecond; subqueries and sparse tables use windows.
STALE = 300_001

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, query: str | Callable, sql: str | None = None, **grid) -> None:
    QUERIES[name] = _text(query, **grid) if isinstance(query, str) else query
    if sql is not None:
        ORACLE[name] = sql


# selectors and matchers
_LASTS = "arg_max(v, t)"
_MATCH = {
    "equal": ('event_type="click"', "event_type = 'click'"),
    "not_equal": ('event_type!="click",user_id!=""', "event_type <> 'click'"),
    "regex": ('event_type=~"click|v.*"', "regexp_full_match(event_type, 'click|v.*')"),
    "regex_not": ('event_type!~"cl.+|view"', "NOT regexp_full_match(event_type, 'cl.+|view')"),
    "regex_in": ('event_type=~"^click|view$"', "event_type IN ('click', 'view')"),
    "regex_prefix": ('user_id=~"1.*"', "user_id LIKE '1%'"),
    "absent_label": ('nolabel="",event_type="error"', "event_type = 'error'"),
}
for _n, (_q, _c) in _MATCH.items():
    add(f"select_{_n}", f"last_over_time(events_value{{{_q}}}[3d])", _over(_EV, _K, _LASTS, W3, cond=_c))
add("select_instant", "events_value", _over(_EV, _K, _LASTS, STALE, _g(step=3_600_000)), step=3_600_000)
add("select_name_matcher", 'sum by (event_type) (sum_over_time({__name__="events_value"}[1d]))', _over(_EV, "event_type", "sum(v)", DAY))
add("select_name_regex", 'count(count_over_time({__name__=~"events_(value|total)"}[1d]))', f"WITH {_EV}, {_g()}, {_win(DAY)} SELECT ts, {_r('2.0 * count(*)')} FROM (SELECT DISTINCT event_type, user_id, ts FROM w) GROUP BY ts")
add("select_column", "sum by (event_type) (sum_over_time(latency::sum[1d]))", f"WITH s AS (SELECT event_type, (epoch_us(date_trunc('hour', ts)) // 1000) AS t, value AS v FROM events), {_g()}, {_win(DAY)} SELECT event_type, ts, {_r('sum(v)')} FROM w GROUP BY event_type, ts")
add("select_type", 'sum(sum_over_time(events_value{_type_="gauge"}[1d]))', f"WITH {_EV}, {_g()}, {_win(DAY)} SELECT ts, {_r('sum(v)')} FROM w GROUP BY ts")

# look-back functions
_ON_EVENTS = {
    "sum_over_time": "sum(v)",
    "avg_over_time": "avg(v)",
    "min_over_time": "min(v)",
    "max_over_time": "max(v)",
    "count_over_time": "count(v)",
    "stddev_over_time": "stddev_pop(v)",
    "stdvar_over_time": "var_pop(v)",
    "last_over_time": "arg_max(v, t)",
    "present_over_time": "1.0",
    "mad_over_time": "mad(v)",
}
for _n, _v in _ON_EVENTS.items():
    add(_n, f"{_n}(events_value[3d])", _over(_EV, _K, _v, W3))
add("quantile_over_time", "quantile_over_time(0.75, events_value[3d])", _over(_EV, _K, "quantile_cont(v, 0.75)", W3))
add("z_score", "z_score(events_value[3d])", _over(_EV, _K, "(arg_max(v, t) - avg(v)) / stddev_pop(v)", W3, having="stddev_pop(v) > 0"))
_X = "(t - ts) / 1000.0"
add("deriv", "deriv(events_value[3d])", _over(_EV, _K, f"regr_slope(v, {_X})", W3, having="count(*) > 1"))
add("predict_linear", "predict_linear(events_value[3d], 3600)", _over(_EV, _K, f"regr_slope(v, {_X}) * 3600 + regr_intercept(v, {_X})", W3, having="count(*) > 1"))
add("mad_outlier", "last_over_time_is_mad_outlier(2, 1, events_value[7d])", _over(_EV, _K, _LASTS, 7 * DAY, having="arg_max(v, t) < median(v) - 2 * mad(v) OR arg_max(v, t) > median(v) + 2 * mad(v)"))


def _steps(source: str, keys: str, window: int) -> str:
    """Samples per window with their predecessor inside it."""
    return f"WITH {source}, {_g()}, {_win(window)}, p AS (SELECT *, lag(v) OVER k AS pv, lag(t) OVER k AS pt, row_number() OVER (PARTITION BY {keys}, ts ORDER BY t DESC) AS back FROM w WINDOW k AS (PARTITION BY {keys}, ts ORDER BY t))"


add("changes", "changes(events_resets[7d])", _steps(_RESETS, _K, 7 * DAY) + f" SELECT {_K}, ts, {_r('count(*) FILTER (pv <> v)')} FROM p GROUP BY {_K}, ts")
add("resets", "resets(events_resets[7d])", _steps(_RESETS, _K, 7 * DAY) + f" SELECT {_K}, ts, {_r('count(*) FILTER (v < pv)')} FROM p GROUP BY {_K}, ts")
add("idelta", "idelta(events_value[7d])", _steps(_EV, _K, 7 * DAY) + f" SELECT {_K}, ts, {_r('v - pv')} FROM p WHERE back = 1 AND pv IS NOT NULL")
add("irate", "irate(events_resets[7d])", _steps(_RESETS, _K, 7 * DAY) + f" SELECT {_K}, ts, {_r('(CASE WHEN v < pv THEN v ELSE v - pv END) / ((t - pt) / 1000.0)')} FROM p WHERE back = 1 AND pv IS NOT NULL AND t > pt")


def _extrapolated(source: str, window: int, counter: bool, rate: bool, scale: str = "1.0") -> str:
    fix = "coalesce(sum(pv) FILTER (v < pv), 0)" if counter else "0"
    zero = "CASE WHEN d > 0 AND v1 >= 0 THEN least(a, span * v1 / d) ELSE a END" if counter else "a"
    per = f" / ({window} / 1000.0)" if rate else ""
    reach = "span + (CASE WHEN a2 < 1.1 * span / (n - 1) THEN a2 ELSE span / (n - 1) / 2 END) + (CASE WHEN z < 1.1 * span / (n - 1) THEN z ELSE span / (n - 1) / 2 END)"
    return _steps(source, _K, window) + f""", q AS (SELECT {_K}, ts, count(*) AS n, arg_max(v, t) - arg_min(v, t) + {fix} AS d, arg_min(v, t) AS v1, (max(t) - min(t)) / 1000.0 AS span,
 (min(t) - (ts - {window})) / 1000.0 AS a, (ts - max(t)) / 1000.0 AS z FROM p GROUP BY {_K}, ts HAVING count(*) > 1 AND max(t) > min(t)), q2 AS (SELECT *, {zero} AS a2 FROM q)
 SELECT {_K}, ts, {_r(f'{scale} * d * ({reach}) / span{per}')} FROM q2"""


add("rate", "rate(events_total[7d]) * 1000", _extrapolated(_TOTAL, 7 * DAY, True, True, "1000.0"))
add("rate_resets", "rate(events_resets[7d]) * 1000", _extrapolated(_RESETS, 7 * DAY, True, True, "1000.0"))
add("increase", "increase(events_resets[7d])", _extrapolated(_RESETS, 7 * DAY, True, False))
add("delta", "delta(events_value[7d])", _extrapolated(_EV, 7 * DAY, False, False))
add("rate_of_deltas", "rate(events_delta[3d])", _over(_DELTA, _K, f"sum(v) / {W3 / 1000}", W3))
add("increase_of_deltas", "increase(events_delta[3d])", _over(_DELTA, _K, "sum(v)", W3))
add("timestamp", "timestamp(events_value)", _over(_EV, _K, "max(t) / 1000.0", STALE, _g(step=3_600_000)), step=3_600_000)
add("holt_winters", "holt_winters(events_value[7d], 0.3, 0.6)")
add("absent_over_time", 'absent_over_time(events_value{event_type="click",user_id="7"}[1d])', f"WITH {_EV}, {_g()} SELECT 'click' AS event_type, '7' AS user_id, ts, {_r('1.0')} FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE event_type = 'click' AND user_id = '7' AND t BETWEEN ts - {DAY} AND ts)")
add("offset", "sum by (event_type) (sum_over_time(events_value[1d] offset 2d))", _over(_EV, "event_type", "sum(v)", DAY, offset=2 * DAY))
add("offset_negative", "sum by (event_type) (sum_over_time(events_value[1d] offset -1d))", _over(_EV, "event_type", "sum(v)", DAY, offset=-DAY))
_AT = f"WITH {_EV}, {_g()}, x AS (SELECT event_type, sum(v) AS v FROM s WHERE t BETWEEN {END - DAY} AND {END} GROUP BY event_type) SELECT event_type, ts, {_r('v')} FROM x, g"
add("at_end", "sum by (event_type) (sum_over_time(events_value[1d] @ end()))", _AT)
add("at_time", f"sum by (event_type) (sum_over_time(events_value[1d] @ {END // 1000}))", _AT)
_SUB = f"WITH {_EV}, i AS (SELECT unnest(generate_series({START - 2 * DAY}::BIGINT, {END}::BIGINT, {DAY // 2}::BIGINT)) AS it), x AS (SELECT event_type, it, sum(v) AS v FROM s JOIN i ON t BETWEEN it - {DAY} AND it GROUP BY event_type, it), {_g()}"
add("subquery_max", "max_over_time(sum by (event_type) (sum_over_time(events_value[1d]))[2d:12h])", _SUB + f" SELECT event_type, ts, {_r('max(v)')} FROM x JOIN g ON it BETWEEN ts - {2 * DAY} AND ts GROUP BY event_type, ts")
add("subquery_avg", "avg_over_time(sum by (event_type) (sum_over_time(events_value[1d]))[2d:12h])", _SUB + f" SELECT event_type, ts, {_r('avg(v)')} FROM x JOIN g ON it BETWEEN ts - {2 * DAY} AND ts GROUP BY event_type, ts")
add("top_level_subquery", lambda spark, d: rounded(engine(spark, d).query("sum by (event_type) (sum_over_time(events_value[1d]))[2d:12h]", END)), f"WITH {_EV}, {_g(END - 2 * DAY, END, DAY // 2)}, {_win(DAY)} SELECT event_type, ts, {_r('sum(v)')} FROM w GROUP BY event_type, ts")
add("range_selector", lambda spark, d: rounded(engine(spark, d).query('events_value{event_type="click"}[2d]', END)), f"WITH {_EV} SELECT {_K}, t AS ts, {_r('v')} FROM s WHERE event_type = 'click' AND t BETWEEN {END - 2 * DAY} AND {END}")

# aggregation
_IN = "sum_over_time(events_value[3d])"


def _agg(value: str, keys: str = "event_type", having: str = "true") -> str:
    k = f"{keys}, " if keys else ""
    return f"WITH {_EV}, {_g()}, {_win(W3)}, x AS (SELECT {_K}, ts, sum(v) AS v FROM w GROUP BY {_K}, ts) SELECT {k}ts, {_r(value)} FROM x GROUP BY {k}ts HAVING {having}"


for _n, _v in {"sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "count(*)", "group": "1.0", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}.items():
    add(f"agg_{_n}", f"{_n} by (event_type) ({_IN})", _agg(_v))
add("agg_all", f"sum({_IN})", _agg("sum(v)", ""))
add("agg_without", f"sum without (user_id) ({_IN})", _agg("sum(v)", "_metric_, event_type"))
add("agg_quantile", f"quantile by (event_type) (0.9, {_IN})", _agg("quantile_cont(v, 0.9)"))


def _topk(order: str) -> str:
    return f"WITH {_EV}, {_g()}, {_win(W3)}, x AS (SELECT {_K}, ts, sum(v) AS v FROM w GROUP BY {_K}, ts), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY v {order}, _metric_, event_type, user_id) AS k FROM x) SELECT {_K}, ts, {_r('v')} FROM r WHERE k <= 3"


add("topk", f"topk by (event_type) (3, {_IN})", _topk("DESC"))
add("bottomk", f"bottomk by (event_type) (3, {_IN})", _topk("ASC"))
add("count_values", 'count_values by (event_type) ("n", count_over_time(events_value[3d]))', f"WITH {_EV}, {_g()}, {_win(W3)}, x AS (SELECT {_K}, ts, count(*) AS v FROM w GROUP BY {_K}, ts) SELECT event_type, CAST(v AS VARCHAR) || '.0' AS n, ts, {_r('count(*)')} FROM x GROUP BY event_type, v, ts")

# operators and joins
_X2 = f"WITH {_EV}, {_g()}, {_win(DAY)}, a AS (SELECT event_type, ts, sum(v) AS x FROM w GROUP BY event_type, ts), b AS (SELECT event_type, ts, count(*) AS y FROM w GROUP BY event_type, ts)"
_A, _B = "sum by (event_type) (sum_over_time(events_value[1d]))", "sum by (event_type) (count_over_time(events_value[1d]))"
for _n, _op, _e in (("add", "+", "x + y"), ("sub", "-", "x - y"), ("mul", "*", "x * y"), ("div", "/", "x / y"), ("mod", "%", "fmod(x, y)"), ("pow", "^", "pow(x, 0.5)")):
    add(f"join_{_n}", f"{_A} {_op} {_B}" if _n != "pow" else f"{_A} ^ 0.5", _X2 + f" SELECT event_type, ts, {_r(_e)} FROM a JOIN b USING (event_type, ts)")
for _n, _op in (("eq", "=="), ("ne", "!="), ("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<=")):
    _s = {"==": "=", "!=": "<>"}.get(_op, _op)
    add(f"compare_{_n}", f"{_B} {_op} 70", _X2 + f" SELECT event_type, ts, {_r('y')} FROM b WHERE y {_s} 70")
    add(f"bool_{_n}", f"{_B} {_op} bool 70", _X2 + f" SELECT event_type, ts, {_r(f'CAST(y {_s} 70 AS DOUBLE)')} FROM b")
add("compare_vectors", f"{_A} > 50 * {_B}", _X2 + f" SELECT event_type, ts, {_r('x')} FROM a JOIN b USING (event_type, ts) WHERE x > 50 * y")
_U = f"WITH {_EV}, {_g()}, {_win(W3)}, a AS (SELECT {_K}, ts, sum(v) AS x FROM w GROUP BY {_K}, ts), b AS (SELECT event_type, ts, sum(v) AS y FROM w GROUP BY event_type, ts)"
_SUM3 = "sum by (event_type) (sum_over_time(events_value[3d]))"
add("group_left", f"{_IN} / on (event_type) group_left {_SUM3}", _U + f" SELECT event_type, user_id, ts, {_r('x / y')} FROM a JOIN b USING (event_type, ts)")
add("group_right", f"{_SUM3} / on (event_type) group_right {_IN}", _U + f" SELECT event_type, user_id, ts, {_r('y / x')} FROM a JOIN b USING (event_type, ts)")
add("group_left_include", f'{_IN} * on (event_type) group_left (kind) label_replace({_SUM3}, "kind", "k-$1", "event_type", "(.).*")', _U + f" SELECT event_type, user_id, 'k-' || event_type[1] AS kind, ts, {_r('x * y')} FROM a JOIN b USING (event_type, ts)")
add("join_ignoring", f"{_IN} - ignoring (user_id) group_left {_SUM3}", _U + f" SELECT event_type, user_id, ts, {_r('x - y')} FROM a JOIN b USING (event_type, ts)")
_BIG = f"WITH {_EV}, {_g()}, {_win(W3)}, a AS (SELECT {_K}, ts, sum(v) AS x FROM w GROUP BY {_K}, ts), big AS (SELECT * FROM a WHERE x > 300)"
add("set_and", f"{_IN} and {_IN} > 300", _BIG + f" SELECT {_K}, ts, {_r('x')} FROM big")
add("set_unless", f"{_IN} unless ({_IN} > 300)", _BIG + f" SELECT {_K}, ts, {_r('x')} FROM a WHERE NOT EXISTS (SELECT 1 FROM big WHERE big.event_type = a.event_type AND big.user_id = a.user_id)")
add("set_or", f"({_IN} > 300) or (0 * {_IN})", _BIG + f" SELECT CASE WHEN x > 300 THEN _metric_ ELSE _metric_ END AS _metric_, event_type, user_id, ts, {_r('CASE WHEN x > 300 THEN x ELSE 0 END')} FROM a")
add("set_and_on", f'{_IN} and on (user_id) sum_over_time(events_value{{event_type="error"}}[3d])', _U + f" SELECT {_K}, ts, {_r('x')} FROM a WHERE EXISTS (SELECT 1 FROM a e WHERE e.event_type = 'error' AND e.user_id = a.user_id AND e.ts = a.ts)")
add("scalar_fold", "2 ^ 3 ^ 0 + 7 % 4 * (1 > bool 0)", f"WITH {_g()} SELECT ts, {_r('5.0')} FROM g")
add("unary_minus", f"-{_SUM3}", _U + f" SELECT event_type, ts, {_r('-y')} FROM b")
add("scalar_function", f"{_SUM3} / scalar(sum({_IN}))", _U + f", tot AS (SELECT ts, sum(y) AS z FROM b GROUP BY ts) SELECT event_type, ts, {_r('y / z')} FROM b JOIN tot USING (ts)")
add("vector_time", "vector(time())", f"WITH {_g()} SELECT ts, {_r('ts / 1000.0')} FROM g")
add("time_scalar", "time() / 60", f"WITH {_g()} SELECT ts, {_r('ts / 60000.0')} FROM g")

# pointwise functions
_POINT = {
    "abs": ("abs({} - 5000)", "abs(y - 5000)"),
    "ceil": ("ceil({} + 0.003)", "ceil(y + 0.003)"),
    "floor": ("floor({} + 0.003)", "floor(y + 0.003)"),
    "exp": ("exp({} / 10000)", "exp(y / 10000)"),
    "sqrt": ("sqrt({})", "sqrt(y)"),
    "ln": ("ln({})", "ln(y)"),
    "log2": ("log2({})", "log2(y)"),
    "log10": ("log10({})", "log10(y)"),
    "sgn": ("sgn({} - 5000)", "sign(y - 5000)"),
    "round": ("round({} + 0.003, 5)", "floor((y + 0.003) * (1.0 / 5) + 0.5) / (1.0 / 5)"),
    "clamp_min": ("clamp_min({}, 5000)", "greatest(y, 5000)"),
    "clamp_max": ("clamp_max({}, 5000)", "least(y, 5000)"),
    "or_vector": ("or_vector({}, 1)", "y"),
}
for _n, (_q, _v) in _POINT.items():
    add(f"fn_{_n}", _q.format(_SUM3), _U + f" SELECT event_type, ts, {_r(_v)} FROM b")
_SECONDS = "make_timestamp(CAST(ts AS BIGINT) * 1000)"
_WHEN = {"year": "year", "month": "month", "day_of_month": "day", "day_of_week": "dayofweek", "hour": "hour", "minute": "minute"}
for _n, _v in _WHEN.items():
    add(f"fn_{_n}", f"{_n}(vector(time()))", f"WITH {_g(step=DAY + 3_660_000)} SELECT ts, {_r(f'{_v}({_SECONDS})')} FROM g", step=DAY + 3_660_000)
add("fn_days_in_month", "days_in_month()", f"WITH {_g()} SELECT ts, {_r(f'day(last_day({_SECONDS}))')} FROM g")

# histograms
_LE_IN = "sum by (event_type, le) (sum_over_time(lat_bucket[1d]))"
_HW = f"WITH {_HIST}, {_g()}, {_win(DAY)}, c AS (SELECT event_type, bound, le, ts, sum(v) AS v FROM w GROUP BY ALL)"
_QUANT = """, q AS (SELECT *, max(v) OVER k AS total, coalesce(lag(v) OVER o, 0) AS low, coalesce(lag(bound) OVER o, 0) AS lo FROM c WINDOW k AS (PARTITION BY event_type, ts), o AS (PARTITION BY event_type, ts ORDER BY bound)),
 f AS (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY bound) AS k FROM q WHERE v >= {q} * total AND total > 0)
 SELECT event_type, ts, round(CASE WHEN isinf(bound) THEN lo ELSE lo + (bound - lo) * CASE WHEN v > low THEN ({q} * total - low) / (v - low) ELSE 0 END END + 1e-7, 5) AS value FROM f WHERE k = 1"""
add("histogram_quantile_le", f"histogram_quantile(0.9, {_LE_IN})", _HW + _QUANT.format(q=0.9))
add("histogram_quantile", "histogram_quantile(0.5, sum by (event_type) (sum_over_time(latency[1d])))", _HW + _QUANT.format(q=0.5))
add("histogram_bucket", "sum by (event_type) (histogram_bucket(50, sum_over_time(latency[1d])))", _HW + f" SELECT event_type, ts, {_r('v')} FROM c WHERE bound = 50")
add("histogram_bucket_selector", 'sum by (event_type) (sum_over_time(latency{_bucket_="50"}[1d]))', _HW + f" SELECT event_type, ts, {_r('v')} FROM c WHERE bound = 50")
add("histogram_suffix_bucket", 'sum by (event_type) (sum_over_time(latency_bucket{le="50"}[1d]))', _HW + f" SELECT event_type, ts, {_r('v')} FROM c WHERE bound = 50")
add("histogram_suffix_count", "sum by (event_type) (sum_over_time(latency_count[1d]))", _HW + f" SELECT event_type, ts, {_r('v')} FROM c WHERE isinf(bound)")
add("histogram_fraction", "histogram_fraction(0, 50, sum by (event_type) (sum_over_time(latency[1d])))", _HW + f" SELECT event_type, ts, {_r('v / t')} FROM c JOIN (SELECT event_type, ts, max(v) AS t FROM c GROUP BY ALL) USING (event_type, ts) WHERE bound = 50")
add("hist_to_prom_vectors", "hist_to_prom_vectors(sum by (event_type) (sum_over_time(latency[1d])))", _HW + f" SELECT event_type, le, ts, {_r('v')} FROM c")
add("histogram_rate", "sum by (event_type, le) (hist_to_prom_vectors(rate(latency[1d])))", _HW + f" SELECT event_type, le, ts, {_r('v / 86400')} FROM c")
add("histogram_max_quantile", "histogram_max_quantile(0.99, sum_over_time(latency[1d]))")
add("histogram_count", "count(sum_over_time(latency[1d]))", _HW + f" SELECT ts, {_r('count(DISTINCT event_type)')} FROM c GROUP BY ts")

# labels, order, absence
add("label_replace", f'label_replace({_SUM3}, "kind", "$2-$1", "event_type", "(.)(.*)")', _U + f" SELECT event_type, event_type[2:] || '-' || event_type[1] AS kind, ts, {_r('y')} FROM b")
add("label_join", f'label_join({_IN}, "both", "/", "event_type", "user_id", "none")', _U + f" SELECT {_K}, event_type || '/' || user_id || '/' AS both, ts, {_r('x')} FROM a")
add("sort_desc", lambda spark, d: rounded(engine(spark, d).query(f"sort_desc({_SUM3})", END)), f"WITH {_EV}, {_g(END, END)}, {_win(W3)} SELECT event_type, ts, {_r('sum(v)')} FROM w GROUP BY event_type, ts")
add("limit", f"{_IN} limit 5", _U + f", l AS (SELECT DISTINCT {_K} FROM a ORDER BY ALL LIMIT 5) SELECT {_K}, ts, {_r('x')} FROM a JOIN l USING ({_K})")
add("absent", 'absent(last_over_time(events_value{event_type="click",user_id="7"}[1d]))', f"WITH {_EV}, {_g()} SELECT ts, {_r('1.0')} FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE event_type = 'click' AND user_id = '7' AND t BETWEEN ts - {DAY} AND ts)")

# other tables
add("orders_weekly", "sum by (status) (sum_over_time(order_price[30d]))", f"WITH {_ORD}, {_g(OT0, OT1, 7 * DAY)}, {_win(30 * DAY)} SELECT status, ts, {_r('sum(v)')} FROM w GROUP BY status, ts", start=OT0, end=OT1, step=7 * DAY)
add("ship_share", "sum by (flag) (sum_over_time(ship_qty[30d])) / on () group_left sum(sum_over_time(ship_qty[30d]))", f"WITH {_SHIP}, {_g(OT0, OT1, 7 * DAY)}, {_win(30 * DAY)}, x AS (SELECT flag, ts, sum(v) AS v FROM w GROUP BY flag, ts) SELECT flag, ts, {_r('v / sum(v) OVER (PARTITION BY ts)')} FROM x", start=OT0, end=OT1, step=7 * DAY)


# metadata
def _table(spark: SparkSession, d: str, metric: str = "events_value") -> MetricTable:
    return engine(spark, d).tables[metric][0]


_SER = f"{_EV}, ser AS (SELECT {_K}, min(t) AS start_ts, max(t) AS end_ts FROM s GROUP BY {_K})"
add("label_values", lambda spark, d: engine(spark, d).label_values("event_type", 'events_value{user_id="3"}'), f"WITH {_SER} SELECT DISTINCT event_type FROM ser WHERE user_id = '3'")
add("label_values_many", lambda spark, d: engine(spark, d).label_values(["event_type", "user_id"], 'events_value{user_id=~"1.*"}', START, END), f"WITH {_SER} SELECT DISTINCT event_type, user_id FROM ser WHERE user_id LIKE '1%' AND end_ts >= {START} AND start_ts <= {END}")
add("label_names", lambda spark, d: engine(spark, d).labels("events_value"), "SELECT unnest(['_metric_', 'event_type', 'user_id']) AS label")
add("series_keys", lambda spark, d: engine(spark, d).series('events_value{event_type="view"}', times=True), f"WITH {_SER} SELECT * FROM ser WHERE event_type = 'view'")
add("label_cardinality", lambda spark, d: metadata.label_cardinality(_table(spark, d), exact=True), f"WITH {_SER} SELECT unnest([struct_pack(label := '_metric_', distinct_values := count(DISTINCT _metric_)), struct_pack(label := 'event_type', distinct_values := count(DISTINCT event_type)), struct_pack(label := 'user_id', distinct_values := count(DISTINCT user_id))], recursive := true) FROM ser")
_CARD = f"count(*) FILTER (end_ts > {END} - 3600000) AS active, count(*) FILTER (end_ts > {END} - 604800000) AS short_term, count(*) AS long_term"
add("cardinalities", lambda spark, d: metadata.cardinalities(_table(spark, d), ["event_type"], END), f"WITH {_SER} SELECT event_type, {_CARD} FROM ser GROUP BY event_type")
add("cardinalities_overflow", lambda spark, d: metadata.cardinalities(_table(spark, d), ["user_id"], END, top=5), f"WITH {_SER}, c AS (SELECT user_id, {_CARD} FROM ser GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY short_term DESC, user_id) AS k FROM c) SELECT CASE WHEN k <= 5 THEN user_id ELSE '_overflow_' END AS user_id, sum(active)::BIGINT AS active, sum(short_term)::BIGINT AS short_term, sum(long_term)::BIGINT AS long_term FROM r GROUP BY 1")
add("value_frequencies", lambda spark, d: metadata.value_frequencies(_table(spark, d), "event_type", 3), f"WITH {_SER} SELECT event_type AS value, count(*) AS series FROM ser GROUP BY 1 ORDER BY series DESC, value LIMIT 3")
add("quota_breaches", lambda spark, d: metadata.check_quota(_table(spark, d), ["user_id"], 4), f"WITH {_SER} SELECT user_id, count(*) AS series FROM ser GROUP BY 1 HAVING count(*) > 4")
add("metering", lambda spark, d: metadata.metering(_table(spark, d), ["event_type"], END), f"WITH {_SER}, c AS (SELECT event_type, {_CARD} FROM ser GROUP BY event_type) SELECT event_type, 'tsdb_metering_' || k AS _metric_, {END}::BIGINT AS ts, CAST(v AS DOUBLE) AS value FROM (UNPIVOT c ON active, short_term, long_term INTO NAME k VALUE v)")
add("label_churn", lambda spark, d: metadata.churn(_table(spark, d), "event_type", ["user_id"], END).drop("distinct_values"), f"WITH {_SER} SELECT event_type AS \"group\", 'user_id' AS label, count(*) FILTER (end_ts > {END} - 3600000) AS active, count(*) FILTER (end_ts > {END} - {3 * DAY}) AS ts_3d, count(*) FILTER (end_ts > {END} - {7 * DAY}) AS ts_7d FROM ser GROUP BY 1")
add("file_chunks", lambda spark, d: metadata.file_chunks(read(spark, d, "events"), "ts").select("n_rows"), "SELECT count(*) AS n_rows FROM events")
add("chunk_meta", 'chunk_meta(events_value{event_type="click"})', f"WITH {_EV} SELECT {_K}, max(t) AS ts, {_r('count(*)')} FROM s WHERE event_type = 'click' AND t BETWEEN {START} AND {END} GROUP BY {_K}")
add("remote_read", lambda spark, d: rounded(engine(spark, d).read('events_value{event_type="view"}', START, START + DAY)), f"WITH {_EV} SELECT {_K}, t AS ts, {_r('v')} FROM s WHERE event_type = 'view' AND t BETWEEN {START} AND {START + DAY}")

# downsampling and jobs
_P = f"CAST(ceil(t / {DAY}.0) * {DAY} AS BIGINT)"


def _round_all(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + 1e-7, 5) for n in names})


add("downsample_gauge", lambda spark, d: _round_all(ds.downsample(_table(spark, d), DAY), "min", "max", "sum", "count", "avg"), f"WITH {_EV} SELECT event_type, user_id, {_P} AS period, max(t) AS ts, round(min(v) + 1e-7, 5) AS min, round(max(v) + 1e-7, 5) AS max, round(sum(v) + 1e-7, 5) AS sum, round(count(v) + 1e-7, 5) AS count, round(avg(v) + 1e-7, 5) AS avg FROM s GROUP BY event_type, user_id, period")


def _again(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d)
    first = ds.downsample(t, 3_600_000).drop("period")
    return _round_all(ds.downsample(MetricTable("events_value", first, t.labels, TS, "ds-gauge"), DAY), "min", "max", "sum", "count", "avg")


add("downsample_twice", _again, ORACLE["downsample_gauge"])
add("downsample_delta", lambda spark, d: _round_all(ds.downsample(_table(spark, d, "events_delta"), DAY).withColumnRenamed("count", "value"), "value"), f"WITH {_EV} SELECT event_type, user_id, {_P} AS period, max(t) AS ts, {_r('sum(v)')} FROM s GROUP BY event_type, user_id, period")


def _rollup_query(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    rolled = ds.downsample(_table(spark, d), 3_600_000).withColumn("ts", F.col("period"))
    e.register("rolled", rolled, ["event_type", "user_id"], schema="ds-gauge")
    return rounded(e.query_range("sum by (event_type) (sum_over_time(rolled[1d]))", START, END, DAY))


add("query_rollup", _rollup_query, f"WITH s0 AS (SELECT event_type, CAST(ceil((epoch_us(ts) // 1000) / 3600000.0) * 3600000 AS BIGINT) AS t, sum(value) AS v FROM events GROUP BY event_type, t), s AS (SELECT * FROM s0), {_g()}, {_win(DAY)} SELECT event_type, ts, {_r('sum(v)')} FROM w GROUP BY event_type, ts")


def _routed(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    rolled = ds.downsample(_table(spark, d), DAY).withColumn("ts", F.col("period"))
    e.register("rolled", rolled, ["event_type", "user_id"], schema="ds-gauge")
    q = "sum by (event_type) (sum_over_time({}[1d]))"
    new, old = e.evaluate(q.format("events_value"), START, DAY, END), e.evaluate(q.format("rolled::max"), START, DAY, END)
    return rounded(ds.routed(new, old, T0 + 20 * DAY).df)


add("route_raw_and_rollup", _routed, f"""WITH {_EV}, {_g()}, {_win(DAY)}, new AS (SELECT event_type, ts, sum(v) AS v FROM w GROUP BY event_type, ts),
 r AS (SELECT event_type, user_id, {_P} AS p, max(v) AS v FROM s GROUP BY ALL), old AS (SELECT event_type, ts, sum(v) AS v FROM r JOIN g ON p BETWEEN ts - {DAY} AND ts GROUP BY event_type, ts)
 SELECT event_type, ts, {_r('v')} FROM (SELECT * FROM old WHERE ts < {T0 + 20 * DAY} UNION ALL SELECT * FROM new WHERE ts >= {T0 + 20 * DAY})""")


def _preaggregated(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    t = _table(spark, d)
    agg = t.df.groupBy("event_type", "ts").agg(F.sum("value").alias("sum"), F.count("*").cast("double").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"))
    e.register("events_value:agg", agg, ["event_type"], schema="preagg-gauge")
    e.rule("events_value", "events_value:agg", ["event_type"])
    return rounded(e.query_range("optimize_with_agg(sum by (event_type) (sum_over_time(events_value[1d])) / sum by (event_type) (count_over_time(events_value[1d])))", START, END, DAY))


add("preaggregated_rewrite", _preaggregated, _X2 + f" SELECT event_type, ts, {_r('x / y')} FROM a JOIN b USING (event_type, ts)")


def _export(spark: SparkSession, d: str) -> DataFrame:
    rule = ds.ExportRule(allow=((Matcher("event_type", "=~", "click|view"),),), block=((Matcher("user_id", "=", "3"),),), drop_labels=("_metric_",), columns=(("user_id", "uid"),))
    return ds.export(_table(spark, d), rule, START, START + 2 * DAY)


add("export_samples", _export, f"WITH {_EV} SELECT event_type, user_id AS uid, t AS ts, v AS value, year(make_timestamp(t * 1000))::INTEGER AS year, month(make_timestamp(t * 1000))::INTEGER AS month, day(make_timestamp(t * 1000))::INTEGER AS day, hour(make_timestamp(t * 1000))::INTEGER AS hour FROM s WHERE t BETWEEN {START} AND {START + 2 * DAY} AND event_type IN ('click', 'view') AND user_id <> '3'")
add("delete_series", lambda spark, d: ds.delete_series(_table(spark, d), (Matcher("event_type", "=", "click"),), (T0, T0 + 2 * DAY), (T0, T0 + 60 * DAY)).select("event_id"), f"WITH {_SER}, gone AS (SELECT * FROM ser WHERE event_type = 'click' AND start_ts BETWEEN {T0} AND {T0 + 2 * DAY}) SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.event_type = e.event_type AND gone.user_id = CAST(e.user_id AS VARCHAR))")
add("delete_series_simulated", lambda spark, d: ds.delete_series(_table(spark, d), (Matcher("event_type", "=", "click"),), (T0, T0 + 2 * DAY), (T0, T0 + 60 * DAY), simulate=True), f"WITH {_SER} SELECT * FROM ser WHERE event_type = 'click' AND start_ts BETWEEN {T0} AND {T0 + 2 * DAY}")
add("repair_copy", lambda spark, d: ds.copied(read(spark, d, "events"), "ts", START, START + DAY).select("event_id"), f"SELECT event_id FROM events WHERE (epoch_us(ts) // 1000) BETWEEN {START} AND {START + DAY}")
add("repair_differences", lambda spark, d: ds.differences(read(spark, d, "events").select("event_id"), ds.copied(read(spark, d, "events"), "ts", START, END).select("event_id")), f"SELECT event_id, 'source' AS side FROM events WHERE NOT (epoch_us(ts) // 1000) BETWEEN {START} AND {END}")
add("purge", lambda spark, d: ds.purge(_table(spark, d), END, 10 * DAY).select("event_id"), f"SELECT event_id FROM events WHERE (epoch_us(ts) // 1000) >= {END - 10 * DAY}")
add("drop_out_of_order", lambda spark, d: drop_out_of_order(raw(_table(spark, d)).df.join(read(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type"), F.col("user_id").cast("string").alias("user_id")), ["event_type", "user_id", "ts"]), ["event_type", "user_id"], [F.desc(F.col("event_id") % 5), "event_id"]).select("event_id"), "SELECT event_id FROM (SELECT event_id, (epoch_us(ts) // 1000) AS t, max((epoch_us(ts) // 1000)) OVER (PARTITION BY event_type, user_id ORDER BY event_id % 5 DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE m IS NULL OR t > m")


def _computed(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "events").select("event_id", "event_type", "user_id", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return df.select("event_id", computed(df, ":string x").alias("c"), computed(df, ":stringPrefix event_type 2").alias("p"), computed(df, ":round user_id 10").alias("r"), computed(df, ":round value 10").alias("rv"), computed(df, ":timeslice ms 1d").alias("s"), computed(df, ":monthOfYear ms").alias("m"), computed(df, ":hash user_id 7").alias("h"), computed(df, ":getOrElse event_type none").alias("e"))


add("computed_columns", _computed, f"SELECT event_id, 'x' AS c, event_type[1:2] AS p, user_id // 10 * 10 AS r, floor(value / 10) * 10 AS rv, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS s, month(ts)::INTEGER AS m, (user_id % 7)::INTEGER AS h, event_type AS e FROM events")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query_range('sum by (event_type) (rate(events_total{event_type=~"click|view"}[1d]))', START, END, DAY)
