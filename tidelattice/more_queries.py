"""Further queries over the test tables: syntax, sources, catalogue, downsampling jobs and smoothing, with DuckDB SQL that must give the same rows."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Engine
from .model import INF, TS, Config, LimitError, QueryError
from .operators import downsample as ds
from .operators import metadata
from .operators.select import FilterMap, raw
from .plans.parser import Matcher
from .queries import _DELTA, _EV, _HIST, _HW, _K, _P, _RESETS, _SER, DAY, END, LES, START, W3, _g, _over, _r, _table, _win, add, engine, read, rounded
from .sources import readers
from .sources.readers import series_table
from .streaming import ingest

# syntax: what the text means is checked by the values that come out
_ONE = f"WITH {_g()} SELECT ts, "
add("parse_precedence", "vector(2 + 3 * 2 ^ 3 ^ 2 / 4 - -1 % 3 + -2 ^ 2)", _ONE + _r("2 + 3 * pow(2, pow(3, 2)) / 4 - (-1) % 3 + -pow(2, 2)") + " FROM g")
add("parse_numbers", "vector(0x1F + 1e2 + 5. + .5 + 1.5E-1)", _ONE + _r("31 + 100 + 5 + 0.5 + 0.15") + " FROM g")
add("parse_comments_and_case", "SUM # the total\n  BY (event_type) (  sum_over_time(events_value[1d]) # of a day\n)", _over(_EV, "event_type", "sum(v)", DAY))
add("parse_strings", 'label_replace(sum by (event_type) (sum_over_time(events_value{event_type=\'click\'}[1d])), "x", "a\\tb\\"c", "event_type", ".*")', f"WITH {_EV}, {_g()}, {_win(DAY)} SELECT event_type, 'a' || chr(9) || 'b\"c' AS x, ts, {_r('sum(v)')} FROM w WHERE event_type = 'click' GROUP BY event_type, ts")
add("parse_durations", "sum by (event_type) (sum_over_time(events_value[1d12h]))", _over(_EV, "event_type", "sum(v)", DAY + DAY // 2))
add("parse_step_durations", "sum by (event_type) (sum_over_time(events_value[2i]))", _over(_EV, "event_type", "sum(v)", 2 * DAY))
add("parse_set_precedence", 'count by (event_type) (sum_over_time(events_value{event_type="click"}[1d])) or count by (event_type) (sum_over_time(events_value{event_type="view"}[1d])) unless count by (event_type) (sum_over_time(events_value[1d]))', _over(_EV, "event_type", "count(DISTINCT user_id)", DAY, cond="event_type = 'click'"))

#: Queries and whether they must be refused: kinds and numbers of arguments, aggregates of histograms, many-to-many arithmetic, lengths of patterns.
_CHECKED = [
    ("topk(events_value)", True),
    ("topk(3, events_value)", False),
    ("quantile(events_value)", True),
    ("count_values(events_value)", True),
    ("sum(3, events_value)", True),
    ("rate(events_total)", True),
    ("abs(events_value, 1)", True),
    ("clamp_min(events_value)", True),
    ("min(latency)", True),
    ("max(latency)", True),
    ("stddev(latency)", True),
    ("sum(latency)", False),
    ("events_value + on (event_type) group_left group_right events_value", True),
    ('events_value{event_type=~"' + "a" * 900 + '.*"}', False),
    ('events_value{event_type=~"' + "a" * 1100 + '.*"}', True),
    ('events_value{event_type=~"' + "a|" * 600 + 'b"}', False),
    ('events_value{event_type=~"' + "a|" * 5100 + 'b"}', True),
]


def _refused(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    rows = []
    for k, (text, _) in enumerate(_CHECKED):
        try:
            e.query_range(text, START, START + DAY, DAY)
            rows.append((k, False))
        except QueryError:
            rows.append((k, True))
    return spark.createDataFrame(rows, "k int, refused boolean")


add("validation", _refused, "SELECT k::INTEGER AS k, refused FROM (VALUES " + ", ".join(f"({k}, {str(r).lower()})" for k, (_, r) in enumerate(_CHECKED)) + ") t(k, refused)")


def _newlines(spark: SparkSession, d: str) -> DataFrame:
    """Patterns match whole labels, a line feed at the end included."""
    e = Engine(spark)
    events = read(spark, d, "events")
    e.register("m", events.withColumn("kind", F.when(F.col("user_id") % 2 == 0, F.concat("event_type", F.lit("\n"))).otherwise(F.col("event_type"))), ["kind", "user_id"])
    return rounded(e.query_range('count(count_over_time(m{kind=~"cl[i]ck"}[1d]))', START, END, DAY))


add("select_regex_newline", _newlines, f"WITH s AS (SELECT user_id, (epoch_us(ts) // 1000) AS t FROM events WHERE event_type = 'click' AND user_id % 2 <> 0), {_g()}, {_win(DAY)} SELECT ts, {_r('count(DISTINCT user_id)')} FROM w GROUP BY ts")


# sources
def _scratch(spark: SparkSession) -> str:
    """A folder of its own in the shared one; a local one only where Spark runs inside the driver."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise QueryError("set spark.checkpoint.dir to a shared folder")
        shared = "file://" + tempfile.mkdtemp(prefix="tidelattice-")
    return f"{shared.rstrip('/')}/rows-{uuid.uuid4().hex}"


def _ms() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))


def _csv(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark)
    read(spark, d, "events").select("event_id", "event_type", _ms().alias("ms"), "value").write.option("header", True).option("sep", ";").csv(path)
    return readers.read_csv(spark, path, "event_id long, event_type string, ms long, value double", separator=";")


add("source_csv", _csv, "SELECT event_id, event_type, (epoch_us(ts) // 1000) AS ms, value FROM events")


def _influx(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "counter").otherwise("value")
    line = F.concat(F.lit("web\\ hits,type="), "event_type", F.lit(",job=j"), (F.col("user_id") % 3).cast("string"), F.lit(",empty= "), kind, F.lit("="), F.round("value", 3).cast("string"), F.lit(",text=\"x\" "), _ms().cast("string"), F.lit("000000"))
    line = F.regexp_replace(line, ",empty= ", " ")
    got = readers.influx_values(readers.parse_influx(read(spark, d, "events").select(line.alias("value"))))
    return got.select("metric", F.col("labels")["type"].alias("type"), F.col("labels")["_ns_"].alias("ns"), TS, F.round("value", 3).alias("value"), "schema")


add("source_influx", _influx, "SELECT 'web hits' AS metric, event_type AS type, 'j' || (user_id % 3) AS ns, (epoch_us(ts) // 1000) AS ts, round(value, 3) AS value, CASE WHEN event_type = 'click' THEN 'prom-counter' ELSE 'gauge' END AS schema FROM events")


def _influx_histogram(spark: SparkSession, d: str) -> DataFrame:
    hour = F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    cells = [F.concat(F.lit(f",{'+Inf' if x == INF else f'{x:g}'}="), F.count_if(F.col("value") <= x).cast("string")) for x in LES]
    lines = read(spark, d, "events").groupBy("event_type", hour.alias("h")).agg(F.concat(F.lit("sum="), F.round(F.sum("value"), 3).cast("string"), F.lit(",count="), F.count("*").cast("string"), *cells).alias("f"))
    got = readers.influx_histograms(readers.parse_influx(lines.select(F.concat(F.lit("lat,type="), "event_type", F.lit(" "), "f", F.lit(" "), F.col("h").cast("string"), F.lit("000000")).alias("value"))))
    return got.select(F.col("labels")["type"].alias("type"), TS, "count", F.size("h.les").alias("n"), F.element_at("h.les", 3).alias("third"), F.element_at("h.counts", 3).alias("below"), F.element_at("h.counts", -1).alias("all_"))


add("source_influx_histogram", _influx_histogram, "SELECT event_type AS type, (epoch_us(date_trunc('hour', ts)) // 1000) AS ts, count(*)::DOUBLE AS count, 8::INTEGER AS n, 10.0::DOUBLE AS third, (count(*) FILTER (value <= 10))::DOUBLE AS below, count(*)::DOUBLE AS all_ FROM events GROUP BY ALL")


def _remote_write(spark: SparkSession, d: str) -> DataFrame:
    label = lambda k, v: F.struct(F.lit(k).alias("name"), v.cast("string").alias("value"))
    rows = read(spark, d, "events").groupBy("event_type", "user_id").agg(F.collect_list(F.struct(F.col("value").alias("value"), _ms().alias("timestamp"))).alias("samples"))
    series = rows.select(F.array(label("__name__", F.lit("hits")), label("type", F.col("event_type")), label("exporter", F.col("user_id"))).alias("labels"), "samples")
    return readers.remote_write(series).select("metric", F.col("labels")["type"].alias("type"), F.col("labels")["exporter"].alias("exporter"), F.col("labels")["_ns_"].alias("ns"), TS, "value")


add("source_remote_write", _remote_write, "SELECT 'hits' AS metric, event_type AS type, user_id::VARCHAR AS exporter, user_id::VARCHAR AS ns, (epoch_us(ts) // 1000) AS ts, value FROM events")


def _records(spark: SparkSession, d: str) -> DataFrame:
    tags = {"type": F.col("event_type"), "_ns": F.when(F.col("user_id") % 2 == 0, F.lit("even"))}
    got = readers.records(read(spark, d, "events"), "gauge", "hits", tags, _ms(), timestamp=_ms(), value=F.col("value"))
    return got.select("metric", F.col("labels")["type"].alias("type"), F.col("labels")["_ns_"].alias("ns"), "timestamp", "value")


add("source_records", _records, "SELECT 'hits' AS metric, event_type AS type, CASE WHEN user_id % 2 = 0 THEN 'even' END AS ns, (epoch_us(ts) // 1000) AS timestamp, value FROM events")


def _placement(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a histogram have one placement hash, whatever their suffix and bucket."""
    events = read(spark, d, "events").select("event_type", "user_id").distinct()
    parts = events.select("event_type", "user_id", F.explode(F.array(*[F.lit(x) for x in ("lat_bucket", "lat_sum", "lat_count", "lat")])).alias("metric"), F.explode(F.array(F.lit("1"), F.lit("+Inf"))).alias("le"))
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("le"), F.col("le"))
    hashed = parts.withColumn("h", readers.partition_hash(F.col("metric"), labels)).withColumn("trimmed", readers.trimmed_metric(F.col("metric")))
    return hashed.groupBy("event_type", "user_id", "trimmed").agg(F.count("*").alias("n"), F.countDistinct("h").alias("hashes"))


add("placement_hash", _placement, "SELECT event_type, user_id, 'lat' AS trimmed, 8::BIGINT AS n, 1::BIGINT AS hashes FROM (SELECT DISTINCT event_type, user_id FROM events)")

# the catalogue
add("series_table", lambda spark, d: series_table(raw(_table(spark, d)).df, ["event_type", "user_id"]), f"WITH {_EV} SELECT {_K}, min(t) AS start_ts, max(t) AS end_ts, count(*) AS n FROM s GROUP BY ALL")


def _store(spark: SparkSession, d: str, question):
    from .sources import store

    path = _scratch(spark)
    events = read(spark, d, "events").select(F.lit("hits").alias("metric"), "event_type", F.col("user_id").cast("string").alias("user_id"), _ms().alias(TS), "value")
    store.write_samples(events.filter("ts % 2 = 0"), path, ["event_type", "user_id"])
    store.write_samples(events.filter("ts % 2 <> 0"), path, ["event_type", "user_id"])
    e = Engine(spark)
    e.register_store(path)
    return question(e)


add("store_samples", lambda spark, d: _store(spark, d, lambda e: rounded(e.query_range("sum by (event_type) (sum_over_time(hits[1d]))", START, END, DAY))), _over(_EV, "event_type", "sum(v)", DAY))
add("store_series", lambda spark, d: _store(spark, d, lambda e: e.series('hits{event_type!="click"}', START, START + 9 * DAY, times=True)), f"WITH {_SER} SELECT 'hits' AS _metric_, event_type, user_id, start_ts, end_ts FROM ser WHERE event_type <> 'click' AND end_ts >= {START} AND start_ts <= {START + 9 * DAY}")
add("store_label_values", lambda spark, d: _store(spark, d, lambda e: e.label_values("event_type", "hits")), "SELECT DISTINCT event_type FROM events")


# look-back functions
def _response(spark: SparkSession, d: str) -> DataFrame:
    """The JSON answer, read back: times in seconds, values as text."""
    e = engine(spark, d)
    got = json.loads(e.response(e.query_range("sum by (event_type) (count_over_time(events_value[1d]))", START, START + 3 * DAY, DAY)))
    rows = [(got["status"], got["data"]["resultType"], s["metric"]["event_type"], float(t), v) for s in got["data"]["result"] for t, v in s["values"]]
    return spark.createDataFrame(rows, "status string, kind string, event_type string, seconds double, value string")


add("response_json", _response, f"WITH {_EV}, {_g(START, START + 3 * DAY)}, {_win(DAY)} SELECT 'success' AS status, 'matrix' AS kind, event_type, (ts / 1000)::DOUBLE AS seconds, count(*)::DOUBLE::VARCHAR AS value FROM w GROUP BY event_type, ts")
add("irate_of_deltas", "irate(events_delta[3d])", f"WITH {_DELTA}, {_g()}, {_win(W3)}, x AS (SELECT {_K}, ts, list_sort(list(t)) AS t, arg_max(v, t) AS v FROM w GROUP BY {_K}, ts) SELECT {_K}, ts, {_r('v / CASE WHEN len(t) > 1 THEN t[-1] - t[-2] ELSE 60 END * 1000')} FROM x WHERE len(t) = 1 OR t[-1] <> t[-2]")
add("irate_histogram", "sum by (event_type) (histogram_bucket(50, irate(latency[3h])))", f"WITH {_HIST}, {_g()}, {_win(3 * 3_600_000)}, x AS (SELECT event_type, ts, list_sort(list(t)) AS t, arg_max(v, t) AS v FROM w WHERE bound = 50 GROUP BY event_type, ts) SELECT event_type, ts, {_r('v / CASE WHEN len(t) > 1 THEN t[-1] - t[-2] ELSE 60000 END * 1000')} FROM x")

_SMOOTHED = f"""WITH RECURSIVE {_EV}, {_g()}, {_win(7 * DAY)},
 o AS (SELECT {_K}, ts, v, row_number() OVER (PARTITION BY {_K}, ts ORDER BY t, v) AS k, count(*) OVER (PARTITION BY {_K}, ts) AS n FROM w),
 r AS (SELECT a.*, a.v AS s, b.v - a.v AS b FROM o a JOIN o b USING ({_K}, ts) WHERE a.k = 1 AND b.k = 2
  UNION ALL SELECT x.*, 0.3 * x.v + 0.7 * (r.s + r.b) AS s, 0.6 * (0.3 * x.v + 0.7 * (r.s + r.b) - r.s) + 0.4 * r.b AS b FROM r JOIN o x ON x.event_type = r.event_type AND x.user_id = r.user_id AND x.ts = r.ts AND x.k = r.k + 1)
 SELECT {_K}, ts, {_r('s')} FROM r WHERE k = n"""
add("holt_winters", "holt_winters(events_value[7d], 0.3, 0.6)", _SMOOTHED)
_MAXED = """, q AS (SELECT *, max(v) OVER k AS total, coalesce(lag(v) OVER o, 0) AS low, coalesce(lag(bound) OVER o, 0) AS lo, lag(bound) OVER o AS below FROM c WINDOW k AS (PARTITION BY event_type, ts), o AS (PARTITION BY event_type, ts ORDER BY bound)),
 m AS (SELECT event_type, ts, max(value) AS top FROM h JOIN g ON t BETWEEN ts - 86400000 AND ts GROUP BY ALL),
 f AS (SELECT q.*, top, row_number() OVER (PARTITION BY q.event_type, q.ts ORDER BY bound) AS k FROM q JOIN m USING (event_type, ts) WHERE v >= 0.99 * total AND total > 0)
 SELECT 'latency' AS _metric_, event_type, ts, round(CASE WHEN isinf(bound) AND NOT (top > lo AND top <= bound) THEN lo ELSE lo + (CASE WHEN top > lo AND top <= bound THEN top ELSE bound END - lo) * SHARE END + 1e-7, 5) AS value FROM f WHERE k = 1"""
add("histogram_max_quantile", "histogram_max_quantile(0.99, sum_over_time(latency[1d]))", _HW + _MAXED.replace("SHARE", "CASE WHEN v > low THEN (0.99 * total - low) / (v - low) ELSE 0 END"))
add("histogram_max_quantile_even", 'histogram_max_quantile_even(0.99, "event_type", sum_over_time(latency[1d]))', _HW + _MAXED.replace("SHARE", "(0.99 * total - low) / (v - low + 1)"))


# downsampling
def _counter(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    return ds.counter_rows(raw(e.tables["events_resets"][0]), DAY)


add("downsample_counter", _counter, f"""WITH {_RESETS}, x AS (SELECT {_K}, t, v, row_number() OVER (PARTITION BY {_K}, {_P} ORDER BY t DESC) = 1 AS last_, row_number() OVER k = 1 AS first_, lag(v) OVER k > v AS drop_, lead(v) OVER k < v AS before_ FROM s WINDOW k AS (PARTITION BY {_K} ORDER BY t))
 SELECT {_K}, t AS ts, v AS value FROM x WHERE last_ OR first_ OR coalesce(drop_, false) OR coalesce(before_, false)""")


def _hist(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    rolled = ds.downsample(e.tables["latency"][0], DAY)
    return rolled.select("event_type", "period", *[F.element_at("h.counts", k + 1).alias(f"b{k}") for k in range(len(LES))])


_CELLS = ", ".join(f"(count(*) FILTER (value <= {'1e999' if x == INF else x}))::DOUBLE AS b{k}" for k, x in enumerate(LES))
add("downsample_histogram", _hist, f"SELECT event_type, {_P} AS period, {_CELLS} FROM (SELECT event_type, value, (epoch_us(date_trunc('hour', ts)) // 1000) AS t FROM events) GROUP BY ALL")


# limits, figures, maps and quotas
def _limited(spark: SparkSession, d: str) -> DataFrame:
    """Which queries go beyond their limits: 5 event types, more users."""
    rows = []
    for k, (text, limits) in enumerate(_LIMITED):
        e = engine(spark, d)
        e.config = Config(enforce=True, **limits)
        try:
            e.query_range(text, START, START + DAY, DAY)
            rows.append((k, False))
        except LimitError:
            rows.append((k, True))
    return spark.createDataFrame(rows, "k int, refused boolean")


_SUMS = "sum by (event_type) (sum_over_time(events_value[1d]))"
_LIMITED = [(_SUMS, {"group_limit": 5}), (_SUMS, {"group_limit": 4}), (f"{_SUMS} + {_SUMS}", {"join_limit": 5}), (f"{_SUMS} + {_SUMS}", {"join_limit": 4}), (_SUMS, {"sample_limit": 10}), (_SUMS, {"sample_limit": 9}), (_SUMS, {"scan_bytes_limit": 1})]
_PAIRS = f"{_EV}, {_g(START, START + DAY)}, {_win(DAY)}, c AS (SELECT count(DISTINCT event_type) AS kinds, count(DISTINCT (event_type, ts)) AS n FROM w)"
add("limits", _limited, f"WITH {_PAIRS} SELECT k::INTEGER AS k, refused FROM (SELECT unnest([struct_pack(k := 0, refused := kinds > 5), struct_pack(k := 1, refused := kinds > 4), struct_pack(k := 2, refused := kinds > 5), struct_pack(k := 3, refused := kinds > 4), struct_pack(k := 4, refused := n > 10), struct_pack(k := 5, refused := n > 9), struct_pack(k := 6, refused := true)], recursive := true) FROM c)")


def _figures(spark: SparkSession, d: str) -> DataFrame:
    df, stats = engine(spark, d).with_stats(_SUMS, START, START + DAY, DAY)
    df.write.format("noop").mode("overwrite").save()
    got = stats.figures()
    return spark.createDataFrame([(got["samples_scanned"], got["result_samples"])], "samples_scanned long, result_samples long")


add("query_statistics", _figures, f"WITH {_PAIRS} SELECT (SELECT count(*) FROM s WHERE t BETWEEN {START - DAY} AND {START + DAY}) AS samples_scanned, n AS result_samples FROM c")


def _two_tables(spark: SparkSession, d: str) -> DataFrame:
    """A metric whose samples lie in two tables, some in both: one series at an instant, stitched in a join."""
    e = Engine(spark)
    users = _daily(spark, d)
    e.register("m", users.filter("n % 3 <> 0"), ["user_id"])
    e.register("m", users.filter("n % 3 <> 1").withColumn("value", F.col("value") + F.when(F.col("n") % 2 == 0, 1).otherwise(0)), ["user_id"])
    return rounded(e.query_range("sum_over_time(m[1h]) + sum_over_time(m[1h])", START, END, DAY))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    day = F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp")))
    return read(spark, d, "events").groupBy("user_id", day.alias("ts")).agg(F.count("*").cast("double").alias("value"), F.count("*").alias("n"))


_DAILY = "u AS (SELECT CAST(user_id AS VARCHAR) AS user_id, (epoch_us(date_trunc('day', ts)) // 1000) AS ts, count(*) AS n FROM events GROUP BY ALL)"
add("join_stitched", _two_tables, f"""WITH {_DAILY}, p AS (SELECT user_id, ts, n::DOUBLE AS v FROM u WHERE n % 3 <> 0 UNION ALL SELECT user_id, ts, n + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END FROM u WHERE n % 3 <> 1)
 SELECT user_id, ts, {_r('2 * min(v)')} FROM p WHERE ts BETWEEN {START} AND {END} GROUP BY user_id, ts HAVING min(v) = max(v)""")
add("histogram_sum_extremes", lambda spark, d: engine(spark, d).query_range("sum(sum_over_time(latency[1d]))", START, END, DAY, extremes=True).select("ts", F.round("max", 5).alias("max"), F.round("min", 5).alias("min"), F.element_at("counts", -1).alias("n")), f"WITH h AS (SELECT (epoch_us(date_trunc('hour', ts)) // 1000) AS t, value FROM events), {_g()} SELECT ts, round(max(value), 5) AS max, round(min(value), 5) AS min, count(*)::DOUBLE AS n FROM h JOIN g ON t BETWEEN ts - {DAY} AND ts GROUP BY ts")


def _own(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    e.function("scaled", lambda v, k, c: v * k + c, 2)
    return rounded(e.query_range(f"scaled({_SUMS}, 2, 1)", START, END, DAY))


add("own_function", _own, _over(_EV, "event_type", "2 * sum(v) + 1", DAY))


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    rules = FilterMap([([Matcher("event_type", "=", "click"), Matcher("user_id", "=~", "1.*")], "8"), ([Matcher("event_type", "=~", "click|view")], "4"), ([Matcher("user_id", "!=", "7")], "2")])
    t = _table(spark, d)
    return t.df.select("event_type", "user_id", rules.column(t.labels).alias("spread")).distinct()


add("filter_map", _mapped, "SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_type = 'click' AND user_id::VARCHAR LIKE '1%' THEN '8' WHEN event_type IN ('click', 'view') THEN '4' WHEN user_id <> 7 THEN '2' END AS spread FROM events")
add("quota_tree", lambda spark, d: metadata.quota_tree(_table(spark, d), ["event_type"], {("click",): 10, (): 4}, 1000), f"""WITH {_SER}, a AS (SELECT event_type, count(*) AS n FROM ser GROUP BY 1),
 l AS (SELECT 1 AS depth, event_type, n AS series, n AS children, CASE event_type WHEN 'click' THEN 10 ELSE 1000 END::BIGINT AS quota FROM a UNION ALL SELECT 0, NULL, sum(n)::BIGINT, count(*), 4 FROM a) SELECT *, children > quota AS breached FROM l""")
add("publish_interval", lambda spark, d: metadata.publish_interval(_table(spark, d).df, "user_id").select("user_id", "publish_ms").distinct(), "SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id, user_id::BIGINT * 1000 AS publish_ms FROM events")
add("session_windows", lambda spark, d: ingest.sessions(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", None, ["event_type"], "value").select("event_type", "start_ts", "end_ts", "n", F.round("sum", 4).alias("sum")), """WITH o AS (SELECT event_type, ts, value, CASE WHEN ts - lag(ts) OVER k < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW k AS (PARTITION BY event_type ORDER BY ts)),
 x AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM o)
 SELECT event_type, epoch_us(min(ts)) // 1000 AS start_ts, epoch_us(max(ts) + INTERVAL 6 HOUR) // 1000 AS end_ts, count(*) AS n, round(sum(value), 4) AS sum FROM x GROUP BY event_type, k""")
