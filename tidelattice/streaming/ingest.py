"""Streaming ingestion: late samples are dropped per series by its last time, kept as keyed state; batches are appended as Parquet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import TS


def drop_late(samples: DataFrame, key: list[str], keep_equal: bool = False, ttl: str | None = None) -> DataFrame:
    """Samples later than every earlier one of their series (arrival order within a batch is time order).

    The state is one long per series; with a ttl (as in "7 days"), series that stay silent that long are forgotten."""
    fields = samples.select(*key, *[c for c in samples.columns if c not in key]).schema
    hold_ms = None if ttl is None else int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for f in frames:
            f = f.sort_values(TS, kind="stable")
            before = f[TS].cummax().shift()
            if last is not None:
                before = before.fillna(last).clip(lower=last)
            ok = before.isna() | (f[TS] >= before if keep_equal else f[TS] > before)
            if len(f):
                top = int(f[TS].max())
                last = top if last is None else max(last, top)
            yield f[ok][fields.names]
        if last is not None:
            state.update((last,))
            if hold_ms is not None:
                state.setTimeoutDuration(hold_ms)

    timeout = GroupStateTimeout.NoTimeout if hold_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return samples.groupBy(*key).applyInPandasWithState(step, fields, "last long", "append", timeout)


def ingest(stream: DataFrame, path: str, checkpoint: str, partition: tuple[str, ...] = (), trigger: str | None = None):
    """Append a stream of samples to Parquet, partitioned by day and the given columns; restarts continue from the checkpoint."""
    rows = stream.withColumn("day", F.to_date(F.timestamp_millis(TS)))
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day", *partition).outputMode("append")
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def sessions(df: DataFrame, time: str, gap: str, delay: str | None, keys: list[str], value: str) -> DataFrame:
    """Sums and counts by session: rows of a key that follow each other within the gap. For streams with a watermark, and for tables."""
    rows = df.withWatermark(time, delay) if df.isStreaming and delay else df
    grouped = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.sum(value).alias("sum"), F.count("*").alias("n"))
    return grouped.select(*keys, F.unix_millis("w.start").alias("start_ts"), F.unix_millis("w.end").alias("end_ts"), "sum", "n")


def windowed(stream: DataFrame, time: str, window: str, slide: str | None, delay: str, keys: list[str], value: str) -> DataFrame:
    """Tumbling or sliding event-time sums and counts, late rows dropped by a watermark."""
    each = F.window(time, window, slide) if slide else F.window(time, window)
    grouped = stream.withWatermark(time, delay).groupBy(each, *keys).agg(F.sum(value).alias("sum"), F.count("*").alias("n"))
    return grouped.select(*keys, F.unix_millis("window.start").alias("start_ts"), F.unix_millis("window.end").alias("end_ts"), "sum", "n")
