"""Made-up series for tests and benchmarks, from spark.range and expressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import exponential


def _base(spark: SparkSession, n_series: int, n_samples: int, start: int, interval: int) -> DataFrame:
    rows = spark.range(n_series * n_samples)
    i, k = (F.col("id") % n_series), F.floor(F.col("id") / n_series)
    return rows.select(F.concat(F.lit("instance-"), i.cast("string")).alias("instance"), F.concat(F.lit("dc"), (i % 2).cast("string")).alias("dc"), (F.lit(start) + k * interval).cast("long").alias("ts"), k.alias("k"), i.alias("i"))


def gauges(spark: SparkSession, n_series: int, n_samples: int, start: int = 0, interval: int = 10_000) -> DataFrame:
    """Sine waves with some noise."""
    return _base(spark, n_series, n_samples, start, interval).select("instance", "dc", "ts", (15 + F.sin(F.col("k") / 10 * math.pi) + F.rand(1)).alias("value"))


def counters(spark: SparkSession, n_series: int, n_samples: int, start: int = 0, interval: int = 10_000, reset_every: int = 0) -> DataFrame:
    k = F.col("k") % reset_every if reset_every else F.col("k")
    return _base(spark, n_series, n_samples, start, interval).select("instance", "dc", "ts", ((k + 1) * (F.col("i") + 1) * 5.0).alias("count"))


def histograms(spark: SparkSession, n_series: int, n_samples: int, les: list[float], start: int = 0, interval: int = 10_000, delta: bool = True) -> DataFrame:
    """Histograms over the given bounds, with sum, count, min and max."""
    grow = F.lit(1) if delta else F.col("k") + 1
    bounds = F.array(*[F.lit(float(x)) for x in les])
    counts = F.transform(bounds, lambda x, i: ((i + 1) * grow * (F.col("i") + 1)).cast("double"))
    top = F.get(counts, F.lit(len(les) - 1))
    h = F.struct(bounds.alias("les"), counts.alias("counts")).alias("h")
    return _base(spark, n_series, n_samples, start, interval).select("instance", "dc", "ts", (top * 2).alias("sum"), top.alias("count"), h, F.lit(0.5).alias("min"), F.lit(float(les[-2])).alias("max"))


def exponential_histograms(spark: SparkSession, n_series: int, n_samples: int, scale: int, first: int, positive: int, start: int = 0, interval: int = 10_000) -> DataFrame:
    """Histograms over exponential buckets of a scale, the first one for zeros."""
    return histograms(spark, n_series, n_samples, exponential(scale, first, positive), start, interval)
