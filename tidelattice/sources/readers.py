"""Reading samples: CSV, Influx line protocol, remote-write records and Kafka, batch or streaming."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import METRIC, SCHEMAS, TS, VALUE

#: Label copied at ingestion, and the labels it is taken from, in order.
COPY_TAGS = {"_ns_": ("_ns", "exporter", "job")}
#: Suffixes that do not count in the partition key of a metric, and the label that does not.
SUFFIXES = ("_bucket", "_count", "_sum")
SAMPLE = "metric string, labels map<string,string>, ts long, value double"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, separator: str = ",", names: Iterable[str] | None = None, streaming: bool = False) -> DataFrame:
    """Rows of CSV files of a given schema; malformed rows become nulls. names: the columns' order where there is no header."""
    reader = (spark.readStream if streaming else spark.read).option("header", header).option("sep", separator).option("mode", "PERMISSIVE").schema(schema)
    df = reader.csv(path)
    return df.toDF(*names) if names else df


def copy_tags(labels: Column, rules: dict[str, tuple[str, ...]] = COPY_TAGS) -> Column:
    """Add each rule's label, from the first of its sources, where the labels lack it."""
    for to, sources in rules.items():
        found = F.coalesce(*[F.try_element_at(labels, F.lit(s)) for s in sources])
        need = ~F.map_contains_key(labels, to) & found.isNotNull()
        labels = F.when(need, F.map_concat(labels, F.create_map(F.lit(to), found))).otherwise(labels)
    return labels


def trimmed_metric(metric: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    return F.regexp_replace(metric, f"({'|'.join(suffixes)})$", "")


def partition_hash(metric: Column, labels: Column) -> Column:
    """Hash for placing a series: its histogram's parts come together, whatever `le`."""
    kept = F.map_filter(labels, lambda k, v: k != "le")
    return F.xxhash64(trimmed_metric(metric), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))))


def split_unescaped(text: Column, separator: str) -> Column:
    return F.split(text, rf"(?<!\\){separator}")


def parse_influx(lines: DataFrame, column: str = "value") -> DataFrame:
    """measurement,tag=v,... field=v,... nanoseconds  ->  metric, labels, fields (map), ts (ms). Lines that are not of the form are dropped."""
    parts = split_unescaped(F.col(column), " ")
    head = split_unescaped(F.get(parts, F.lit(0)), ",")
    pair = lambda x: F.struct(F.regexp_replace(F.get(split_unescaped(x, "="), F.lit(0)), r"\\(.)", "$1").alias("key"), F.regexp_replace(F.get(split_unescaped(x, "="), F.lit(1)), r"\\(.)", "$1").alias("value"))
    tags = F.map_from_entries(F.filter(F.transform(F.slice(head, F.lit(2), F.greatest(F.size(head) - 1, F.lit(0))), pair), lambda p: p["value"].isNotNull() & (p["value"] != "")))
    fields = F.map_from_entries(F.transform(F.filter(split_unescaped(F.get(parts, F.lit(1)), ","), lambda x: x.contains("=")), pair))
    numbers = F.map_filter(F.transform_values(fields, lambda k, v: F.regexp_replace(v, "i$", "").try_cast("double")), lambda k, v: v.isNotNull())
    rows = lines.filter((F.size(parts) >= 2) & F.get(parts, F.lit(1)).contains("="))
    out = rows.select(F.regexp_replace(F.get(head, F.lit(0)), r"\\(.)", "$1").alias("metric"), copy_tags(tags).alias("labels"), numbers.alias("fields"), F.call_function("div", F.get(parts, F.lit(2)).try_cast("long"), F.lit(1_000_000)).alias(TS))
    return out.filter("size(fields) > 0")


def influx_schema(fields: Column) -> Column:
    """The data schema a line belongs to: a counter, a histogram (sum, count and bucket bounds), or a gauge."""
    has = lambda k: F.map_contains_key(fields, k)
    return F.when(has("counter"), "prom-counter").when((F.size(fields) >= 3) & has("sum") & has("count"), "prom-histogram").otherwise("gauge")


def influx_histograms(parsed: DataFrame) -> DataFrame:
    """Histogram lines as metric, labels, ts, sum, count, h."""
    rows = parsed.filter(influx_schema(F.col("fields")) == "prom-histogram")
    bound = lambda k: F.when(F.lower(k).isin("+inf", "inf"), F.lit(float("inf"))).otherwise(k.try_cast("double"))
    tops = F.array_sort(F.filter(F.transform(F.map_entries("fields"), lambda e: F.struct(bound(e["key"]).alias("le"), e["value"].alias("n"))), lambda e: e["le"].isNotNull()))
    return rows.withColumn("b", tops).select("metric", "labels", TS, F.col("fields")["sum"].alias("sum"), F.col("fields")["count"].alias("count"), F.struct(F.transform("b", lambda x: x["le"]).alias("les"), F.transform("b", lambda x: x["n"]).alias("counts")).alias("h"))


def influx_values(parsed: DataFrame) -> DataFrame:
    """Gauge and counter lines as metric, labels, ts, value and schema; a line's single value is its field counter, gauge or value, or its only one."""
    f = F.col("fields")
    kind = influx_schema(f)
    value = F.coalesce(*[F.try_element_at(f, F.lit(k)) for k in ("counter", "gauge", "value")], F.get(F.map_values(f), F.lit(0)))
    return parsed.select("metric", "labels", TS, value.alias(VALUE), kind.alias("schema")).filter("schema != 'prom-histogram'")


def remote_write(series: DataFrame) -> DataFrame:
    """Time series (labels: array of name, value; samples: array of value, timestamp) as sample rows. The metric is the label __name__."""
    labels = F.map_from_entries(F.transform("labels", lambda x: F.struct(x["name"], x["value"])))
    rows = series.select(labels.alias("all"), F.explode("samples").alias("s"))
    metric = F.try_element_at("all", F.lit("__name__"))
    return rows.select(metric.alias("metric"), copy_tags(F.map_filter("all", lambda k, v: k != "__name__")).alias("labels"), F.col("s.timestamp").cast("long").alias(TS), F.col("s.value").cast("double").alias(VALUE)).filter("metric is not null")


def read_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "latest", ending: str | None = None, streaming: bool = True) -> DataFrame:
    """Samples from JSON records of a topic; offsets as Spark's Kafka source takes them. Needs Spark's Kafka package."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
    if ending and not streaming:
        reader = reader.option("endingOffsets", ending)
    return reader.load().select(F.from_json(F.col("value").cast("string"), SAMPLE).alias("s"), "partition", "offset").select("s.*", "partition", "offset")


def write_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str | None = None):
    """Samples to a topic as JSON records keyed by their placement hash, batch or streaming."""
    rows = df.select(partition_hash(F.col("metric"), F.col("labels")).cast("string").alias("key"), F.to_json(F.struct("metric", "labels", TS, VALUE)).alias("value"))
    options = {"kafka.bootstrap.servers": servers, "topic": topic}
    if df.isStreaming:
        return rows.writeStream.format("kafka").options(**options, checkpointLocation=checkpoint).start()
    return rows.write.format("kafka").options(**options).save()


def records(df: DataFrame, schema: str, metric: str, labels: dict[str, Column], ts: Column, **values: Column) -> DataFrame:
    """Rows of a data schema from any DataFrame: metric, labels, timestamp and the schema's columns, checked and cast."""
    columns = []
    for c in SCHEMAS[schema].columns:
        if c.name not in values:
            raise ValueError(f"schema {schema} needs {c.name}")
        kind = SCHEMAS[schema].struct()[c.name].dataType
        columns.append(values[c.name].cast(kind).alias(c.name))
    made = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), v.cast("string"))]) if labels else F.create_map().cast("map<string,string>")
    return df.select(F.lit(metric).alias("metric"), copy_tags(F.map_filter(made, lambda k, v: v.isNotNull())).alias("labels"), ts.cast("long").alias("timestamp"), *columns)


def series_table(samples: DataFrame, labels: Iterable[str]) -> DataFrame:
    """The catalogue of series, rebuilt from samples: labels, first and last time, samples."""
    return samples.groupBy(METRIC, *labels).agg(F.min(TS).alias("start_ts"), F.max(TS).alias("end_ts"), F.count("*").alias("n"))
