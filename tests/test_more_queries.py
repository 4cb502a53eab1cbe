"""Queries over syntax, sources, the store and downsampling against their SQL, and what their plans read."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelattice import more_queries, queries
from tidelattice.api import Engine
from tidelattice.operators import downsample as ds
from tidelattice.queries import DAY, END, START
from tidelattice.sources import store

D = "/root/testdata/sf0.001"
NAMES = """parse_precedence parse_numbers parse_comments_and_case parse_strings parse_durations parse_step_durations parse_set_precedence validation
 select_regex_newline source_csv source_influx source_influx_histogram source_remote_write source_records placement_hash series_table store_samples store_series
 store_label_values response_json irate_of_deltas irate_histogram holt_winters histogram_max_quantile histogram_max_quantile_even downsample_counter downsample_histogram
 limits query_statistics join_stitched histogram_sum_extremes own_function filter_map quota_tree publish_interval session_windows""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{D}/events.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_and_sql_agree(spark, duck, name):
    df = queries.QUERIES[name](spark, D)
    got = duck.execute(queries.ORACLE[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, got.fetchall()))


def _plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_time_ranges_reach_the_scan(spark):
    t = queries._table(spark, D)
    for df in (ds.purge(t, END, DAY), ds.copied(queries.read(spark, D, "events"), "ts", START, END), ds.downsample(t, DAY, START, END)):
        assert "GreaterThanOrEqual(ts" in _plan(df)


def test_questions_about_a_store_read_no_samples(spark, tmp_path):
    rows = queries.read(spark, D, "events").select(F.lit("a=b c").alias("metric"), "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "value")
    for part in (0, 1):
        store.write_samples(rows.filter(F.col("ts") % 2 == part), f"file://{tmp_path}", ["event_type"])
    e = Engine(spark)
    e.register_store(f"file://{tmp_path}")
    assert set(e.tables) == {"a=b c"}
    found = e.label_values("event_type", '{__name__="a=b c"}')
    assert f"{tmp_path}/{store.CATALOGUE}" in _plan(found) and f"{tmp_path}/gauge" not in _plan(found)
    assert {r[0] for r in found.collect()} == {r[0] for r in rows.select("event_type").distinct().collect()}
    got = e.series('{__name__="a=b c"}', times=True).collect()
    want = {r["event_type"]: (r["a"], r["b"]) for r in rows.groupBy("event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()}
    assert {r["event_type"]: (r["start_ts"], r["end_ts"]) for r in got} == want
    store.compact_series(spark, f"file://{tmp_path}", "gauge", f"file://{tmp_path}/merged")
    assert spark.read.parquet(f"file://{tmp_path}/merged").count() == len(want)


def test_more_queries_are_registered():
    assert more_queries and set(NAMES) <= set(queries.QUERIES) and set(NAMES) <= set(queries.ORACLE)
