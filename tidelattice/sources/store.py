"""The sample store: Parquet by schema, metric and day, sorted by series and time inside each file; and a catalogue of series.

Each append adds its series with their first and last times to the catalogue (by schema and metric); readers merge what the appends have left, so
questions about series read no samples. compact_series() merges it on disk. Sorting gives label columns and ts narrow ranges per row group, so matchers and time ranges skip most of a file.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SCHEMAS, TS, MetricTable, QueryError

#: Folder of the catalogue inside a store; no schema has this name.
CATALOGUE = "series"


def write_samples(df: DataFrame, path: str, labels: Iterable[str], schema: str = "gauge", parts_per_day: int = 8, metric: str = "metric", mode: str = "append") -> None:
    """Append samples (metric, label columns, ts in ms, the schema's columns). A day's series are dealt over parts_per_day files by a hash of
    their labels: one hot metric does not become one task."""
    if schema not in SCHEMAS:
        raise QueryError(f"no schema {schema}")
    labels = list(labels)
    rows = df.withColumn("day", F.to_date(F.timestamp_millis(TS))).withColumn("__part", F.pmod(F.xxhash64(*labels), F.lit(parts_per_day)) if labels else F.lit(0))
    spread = rows.repartition(metric, "day", "__part").sortWithinPartitions(metric, "day", *labels, TS).drop("__part")
    spread.withColumnRenamed(metric, "metric").write.mode(mode).partitionBy("metric", "day").parquet(f"{path}/{schema}")
    found = df.withColumnRenamed(metric, "metric").groupBy("metric", *labels).agg(F.min(TS).alias("start_ts"), F.max(TS).alias("end_ts"))
    found.write.mode(mode).partitionBy("metric").parquet(f"{path}/{CATALOGUE}/{schema}")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, which need not exist; no file is opened and no task runs."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def compact_series(spark: SparkSession, path: str, schema: str, to: str) -> None:
    """Write the merged catalogue of a schema to another folder, which then may take the place of the old one."""
    df = spark.read.parquet(f"{path}/{CATALOGUE}/{schema}")
    labels = [c for c in df.columns if c not in ("metric", "start_ts", "end_ts")]
    merged_series(None, df, labels, ("start_ts", "end_ts")).write.partitionBy("metric").parquet(to)


def tables(spark: SparkSession, path: str) -> Iterator[MetricTable]:
    """The store's metrics, found from its folders."""
    for name, schema in SCHEMAS.items():
        metrics = [unquote(f.removeprefix("metric=")) for f in _folders(spark, f"{path}/{name}") if f.startswith("metric=")]
        if not metrics:
            continue  # no samples of this schema
        df = spark.read.parquet(f"{path}/{name}")
        known = spark.read.parquet(f"{path}/{CATALOGUE}/{name}") if _folders(spark, f"{path}/{CATALOGUE}/{name}") else None
        values = {c.name for c in schema.columns}
        labels = tuple(c for c in df.columns if c not in values | {TS, "metric", "day"})
        for m in metrics:
            one = None if known is None else known.filter(F.col("metric") == m).drop("metric")
            yield MetricTable(m, df.filter(F.col("metric") == m).drop("metric"), labels, TS, name, day="day", catalogue=one)


def merged_series(old: DataFrame | None, new: DataFrame, labels: Iterable[str], times: tuple[str, str] = (TS, TS)) -> DataFrame:
    """The series table after new samples, or parts with first and last `times`: first and last times by series."""
    keys = ["metric", *labels]
    fresh = new.groupBy(*keys).agg(F.min(times[0]).alias("start_ts"), F.max(times[1]).alias("end_ts"))
    both = fresh if old is None else old.unionByName(fresh)
    return both.groupBy(*keys).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
