"""Sources, streaming, downsampling, export, repair and computed columns."""

import pytest
from pyspark.sql import functions as F

from tidelattice.functions.computed import computed
from tidelattice.model import MetricTable, QueryError
from tidelattice.operators import downsample as ds
from tidelattice.operators import metadata
from tidelattice.operators.grid import stitch
from tidelattice.operators.select import FilterMap, drop_out_of_order, raw
from tidelattice.plans.parser import Matcher
from tidelattice.sources import readers, synthetic
from tidelattice.streaming import ingest

GAUGE = "s string, ts long, value double"


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;name;v\n1;x;2.5\nbad;;\n")
    rows = readers.read_csv(spark, str(tmp_path), "id int, name string, v double", separator=";").collect()
    assert [tuple(r) for r in rows] == [(1, "x", 2.5), (None, None, None)]


def test_influx(spark):
    lines = spark.createDataFrame(
        [(x,) for x in (r"cpu\ load,host=a,dc=x,exporter=e value=1.5 1000000000", "reqs,host=a counter=7i 2000000000", "lat,host=b sum=9,count=4,1=1,2.5=3,+Inf=4 3000000000", "broken", "x,h=1 notanumber=zz 5")], "value string"
    )
    parsed = readers.parse_influx(lines)
    got = {r["metric"]: r for r in readers.influx_values(parsed).collect()}
    assert got["cpu load"]["value"] == 1.5 and got["cpu load"]["ts"] == 1000 and got["cpu load"]["labels"] == {"host": "a", "dc": "x", "exporter": "e", "_ns_": "e"}
    assert got["reqs"]["schema"] == "prom-counter" and got["reqs"]["value"] == 7.0 and set(got) == {"cpu load", "reqs"}
    h = readers.influx_histograms(parsed).first()
    assert h["h"]["les"] == [1.0, 2.5, float("inf")] and h["h"]["counts"] == [1.0, 3.0, 4.0] and h["sum"] == 9.0


def test_remote_write_and_placement(spark):
    rows = [([("__name__", "m"), ("job", "j")], [(1.0, 5), (2.0, 6)])]
    df = spark.createDataFrame(rows, "labels array<struct<name:string,value:string>>, samples array<struct<value:double,timestamp:long>>")
    got = readers.remote_write(df).orderBy("ts").collect()
    assert [(r["metric"], r["ts"], r["value"]) for r in got] == [("m", 5, 1.0), ("m", 6, 2.0)] and got[0]["labels"] == {"job": "j", "_ns_": "j"}
    two = spark.createDataFrame([("h_bucket", {"le": "1", "a": "x"}), ("h_sum", {"a": "x"})], "m string, l map<string,string>")
    assert two.select(readers.partition_hash(F.col("m"), F.col("l"))).distinct().count() == 1


def test_records(spark):
    df = spark.createDataFrame([("a", 5, 2)], "host string, t long, v int")
    r = readers.records(df, "gauge", "m", {"host": F.col("host")}, F.col("t"), value=F.col("v")).first()
    assert r["value"] == 2.0 and r["labels"] == {"host": "a"} and r["timestamp"] == 5
    with pytest.raises(ValueError):
        readers.records(df, "prom-counter", "m", {}, F.col("t"))


def test_synthetic(spark):
    assert synthetic.gauges(spark, 3, 10).groupBy("instance").count().count() == 3
    c = synthetic.counters(spark, 1, 10, reset_every=4).orderBy("ts").collect()
    assert [r["count"] for r in c][:5] == [5.0, 10.0, 15.0, 20.0, 5.0]
    h = synthetic.histograms(spark, 1, 2, [1.0, 2.0, float("inf")], delta=False).orderBy("ts").collect()
    assert h[1]["h"]["counts"] == [2.0, 4.0, 6.0]


def test_out_of_order_samples_are_dropped(spark):
    rows = [("a", 1, 10), ("a", 2, 5), ("a", 3, 10), ("a", 4, 11), ("b", 5, 1)]
    df = spark.createDataFrame(rows, "s string, k long, ts long")
    assert [r["k"] for r in drop_out_of_order(df, ["s"], ["k"]).orderBy("k").collect()] == [1, 4, 5]
    assert [r["k"] for r in drop_out_of_order(df, ["s"], ["k"], keep_equal=True).orderBy("k").collect()] == [1, 3, 4, 5]


def test_streaming_drops_late_samples(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    batches = [[("a", 10, 1.0), ("a", 20, 2.0), ("b", 5, 3.0)], [("a", 15, 4.0), ("a", 21, 5.0), ("b", 5, 6.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, GAUGE).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(GAUGE).parquet(str(src))
        q = ingest.ingest(ingest.drop_late(stream, ["s"]), str(out), str(tmp_path / "cp"))
        q.awaitTermination(120)
        q.stop()
    got = sorted((r["s"], r["ts"], r["value"]) for r in spark.read.parquet(str(out)).collect())
    assert got == [("a", 10, 1.0), ("a", 20, 2.0), ("a", 21, 5.0), ("b", 5, 3.0)]
    assert "day" in spark.read.parquet(str(out)).columns


def test_streaming_windows(spark, tmp_path):
    spark.createDataFrame([("a", i * 60, 1.0) for i in range(30)], "s string, t long, v double").select("s", F.timestamp_seconds("t").alias("t"), "v").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string, t timestamp, v double").parquet(str(tmp_path / "in"))
    q = ingest.windowed(stream, "t", "10 minutes", None, "1 minute", ["s"], "v").writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["start_ts"], r["n"]) for r in spark.sql("select * from tumbling").collect()) == [(0, 10), (600_000, 10), (1_200_000, 10)]


@pytest.fixture
def gauge(spark):
    rows = [("a", t, float(t % 7)) for t in range(1, 41)] + [("b", 10, float("nan")), ("b", 11, 4.0)]
    return MetricTable("m", spark.createDataFrame(rows, GAUGE), ("s",))


def test_downsampling(gauge):
    got = {(r["s"], r["period"]): r for r in ds.downsample(gauge, 10).collect()}
    assert got["a", 10]["count"] == 10 and got["a", 10]["ts"] == 10 and got["a", 20]["sum"] == sum(t % 7 for t in range(11, 21))
    assert got["b", 20]["avg"] == 4.0 and got["b", 10]["count"] == 0 and got["b", 10]["min"] is None


def test_counter_rows(spark):
    rows = [("a", t, v) for t, v in ((1, 1.0), (2, 5.0), (3, 2.0), (4, 3.0), (9, 4.0), (12, 6.0))]
    v = raw(MetricTable("m", spark.createDataFrame(rows, GAUGE), ("s",)))
    assert [r["ts"] for r in ds.counter_rows(v, 10).orderBy("ts").collect()] == [1, 2, 3, 9, 12]


def test_histogram_rollup(spark):
    rows = [("a", t, 1.0, 2.0, ([1.0, float("inf")], [1.0, 2.0])) for t in (1, 2, 11)]
    t = MetricTable("h", spark.createDataFrame(rows, "s string, ts long, sum double, count double, h struct<les:array<double>,counts:array<double>>"), ("s",), schema="delta-histogram")
    got = {r["period"]: r for r in ds.downsample(t, 10).collect()}
    assert got[10]["h"]["counts"] == [2.0, 4.0] and got[10]["sum"] == 2.0 and got[20]["h"]["counts"] == [1.0, 2.0]


def test_config_and_routing(spark, gauge):
    c = ds.DownsampleConfig((300_000, 3_600_000), (30 * 86_400_000, 365 * 86_400_000))
    now = 400 * 86_400_000
    assert [c.resolution_for(now - d * 86_400_000, now) for d in (1, 10, 100, 400)] == [0, 300_000, 3_600_000, 3_600_000]
    for bad in (((2, 1), (1, 2)), ((1, 2), (1,))):
        with pytest.raises(QueryError):
            ds.DownsampleConfig(*bad)
    a = raw(MetricTable("m", spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], GAUGE), ("s",)))
    b = raw(MetricTable("m", spark.createDataFrame([("a", 2, 3.0), ("a", 3, 4.0), ("a", 1, 1.0)], GAUGE), ("s",)))
    assert sorted((r["ts"], r["value"]) for r in stitch([a, b]).df.collect()) == [(1, 1.0), (3, 4.0)]


def test_export_writes_partitions(spark, gauge, tmp_path):
    rule = ds.ExportRule(block=((Matcher("s", "=", "b"),),), drop_labels=("_metric_",), columns=(("s", "series"),))
    ds.write_export(ds.export(gauge, rule, 0, 100), str(tmp_path / "x"))
    back = spark.read.parquet(str(tmp_path / "x"))
    assert back.count() == 40 and set(back.columns) == {"series", "ts", "value", "year", "month", "day", "hour"}


def test_delete_and_repair(gauge):
    left = ds.delete_series(gauge, (Matcher("s", "=", "a"),), (0, 5), (0, 100))
    assert {r["s"] for r in left.collect()} == {"b"}
    assert ds.delete_series(gauge, (), (0, 5), (0, 100), simulate=True).count() == 1
    assert ds.copied(gauge.df, "ts", 5, 7).count() == 3
    d = ds.differences(gauge.df, ds.copied(gauge.df, "ts", 1, 39))
    assert [(r["s"], r["ts"], r["side"]) for r in d.collect()] == [("a", 40, "source")]
    assert ds.purge(gauge, 50, 10).count() == 1 and ds.keep_matching(gauge, (Matcher("s", "=", "b"),)).count() == 2


def test_metadata(gauge):
    assert [tuple(r) for r in metadata.cardinalities(gauge, ["s"], 41, active_ms=5, short_ms=50).collect()] == [("a", 1, 1, 1), ("b", 0, 1, 1)]
    with pytest.raises(QueryError):
        metadata.cardinalities(gauge, [], 0)
    assert {r["label"]: r["distinct_values"] for r in metadata.label_cardinality(gauge).collect()} == {"_metric_": 1, "s": 2}
    assert metadata.churn(gauge, "_metric_", ["s"], 41).first()["distinct_values"] == 2


def test_quota_tree_and_publish_interval(spark):
    rows = [("w", "n1", "a"), ("w", "n1", "b"), ("w", "n2", "c"), ("v", "n1", "d"), ("v", "n1", "d")]
    df = spark.createDataFrame([(*r, 1, 1.0) for r in rows], "ws string, ns string, host string, ts long, value double")
    table = MetricTable("m", df, ("ws", "ns", "host"), "ts")
    tree = metadata.quota_tree(table, ["ws", "ns"], {("w",): 1, (): 2}, 5)
    got = {(r["depth"], r["ws"], r["ns"]): (r["series"], r["children"], r["quota"], r["breached"]) for r in tree.collect()}
    assert got == {(0, None, None): (4, 2, 2, False), (1, "w", None): (3, 2, 1, True), (1, "v", None): (1, 1, 5, False), (2, "w", "n1"): (2, 2, 5, False), (2, "w", "n2"): (1, 1, 5, False), (2, "v", "n1"): (1, 1, 5, False)}
    with pytest.raises(QueryError, match="quota"):
        metadata.enforce_quotas(tree)
    assert metadata.enforce_quotas(tree.filter("depth <> 1")).count() == 4
    none = metadata.quota_tree(MetricTable("m", df.limit(0), ("ws", "ns", "host"), "ts"), ["ws"])
    assert [(r["series"], r["children"]) for r in none.collect()] == [(0, 0)]
    steps = spark.createDataFrame([("30",), ("x",), (None,)], "_pi_ string")
    assert [r["publish_ms"] for r in metadata.publish_interval(steps).collect()] == [30_000, None, None]
    assert metadata.publish_interval(df).first()["publish_ms"] is None


def test_filter_map(spark):
    rules = [([Matcher("a", "=", "1"), Matcher("b", "=~", "x.*")], "one"), ([Matcher("a", "=", "1")], "two"), ([Matcher("c", "!=", "q")], "three")]
    m = FilterMap(rules)
    df = spark.createDataFrame([("1", "xy", None), ("1", "y", None), ("2", None, "z"), ("2", "x", "q"), (None, None, None)], "a string, b string, c string")
    want = ["one", "two", "three", None, None]
    assert [r[0] for r in df.select(m.column(df.columns)).collect()] == want
    assert [m.get({k: v for k, v in r.asDict().items() if v is not None}) for r in df.collect()] == want
    assert [r[0] for r in df.select(m.column(["b"])).collect()] == [None] * 5


def test_sessions(spark):
    rows = [("a", 0, 1.0), ("a", 50, 2.0), ("a", 200, 4.0), ("b", 10, 8.0)]
    df = spark.createDataFrame(rows, "s string, at long, v double").withColumn("t", F.timestamp_seconds("at"))
    want = {("a", 0, 110_000, 3.0, 2), ("a", 200_000, 260_000, 4.0, 1), ("b", 10_000, 70_000, 8.0, 1)}
    assert {tuple(r) for r in ingest.sessions(df, "t", "60 seconds", None, ["s"], "v").collect()} == want


def test_exponential_generator(spark):
    df = synthetic.exponential_histograms(spark, 2, 3, 1, -2, 4)
    r = df.orderBy("instance", "ts").first()
    assert df.count() == 6 and r["h"]["les"][0] == 0.0 and r["h"]["les"][-1] == pytest.approx(2.0) and r["h"]["counts"] == sorted(r["h"]["counts"])


def test_computed_columns(spark):
    df = spark.createDataFrame([(-17, "hello", 12.7, 90_061_000, None)], "i long, s string, d double, ms long, n string")
    f = lambda x: df.select(computed(df, x)).first()[0]
    assert f(":round i 10") == -10 and f(":round d 5") == 10.0 and f(":stringPrefix s 2") == "he" and f(":timeslice ms 1h") == 90_000_000 and f(":monthOfYear ms") == 1 and f(":getOrElse n x") == "x" and f(":string q") == "q" and f(":hash i 5") == 2 and f("s") == "hello"
    for bad in (":nope s", ":round i"):
        with pytest.raises(QueryError):
            f(bad)


def test_store(spark, tmp_path, capsys):
    from tidelattice.__main__ import main
    from tidelattice.api import Engine
    from tidelattice.sources import store

    day = 86_400_000
    rows = [("m", "a", t * day + 5, float(t)) for t in range(3)] + [("n", "b", 5, 9.0)]
    df = spark.createDataFrame(rows, "metric string, s string, ts long, value double")
    store.write_samples(df, str(tmp_path), ["s"])
    e = Engine(spark)
    e.register_store(str(tmp_path))
    assert set(e.tables) == {"m", "n"} and [r["value"] for r in e.query("sum_over_time(m[1d])", 2 * day).collect()] == [1.0]
    plan = e.explain("sum_over_time(m[1d])", 2 * day, 2 * day, 0)
    assert "PartitionFilters" in plan and "day" in plan[plan.index("PartitionFilters") : plan.index("PartitionFilters") + 300]
    first = store.merged_series(None, df, ["s"])
    both = store.merged_series(first, df.withColumn("ts", F.col("ts") + day), ["s"])
    assert {(r["metric"], r["start_ts"], r["end_ts"]) for r in both.collect()} == {("m", 5, 3 * day + 5), ("n", 5, day + 5)}
    main([str(tmp_path), "list"])
    main([str(tmp_path), "query", "m", "--start", "6"])
    main([str(tmp_path), "cardinality", "s", "m", "--start", "6"])
    main([str(tmp_path), "indexnames"])
    main([str(tmp_path), "indexvalues", "s", "m"])
    main([str(tmp_path), "stats", "sum_over_time(m[1d])", "--start", "6"])
    out = capsys.readouterr().out
    assert "0.0" in out and "samples_scanned: 1" in out
