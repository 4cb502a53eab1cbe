"""Intermediate tables in the shared folder, and joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a local one of our own if Spark runs inside the driver; on a
    cluster, whose machines would not see each other's files, an error."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        got = spark.sparkContext.getCheckpointDir()
    if not got:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="tidelattice-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


#: Bytes of one Arrow batch between Spark and a Python worker, unless the session has a smaller number.
BATCH_BYTES = 1 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the batches that Python workers get by bytes, so that long texts do not make them large. Every operator begins with this.

    The setting is the session's: a smaller one of the user's stays, and a larger one becomes BATCH_BYTES."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark = df.sparkSession
    now = str(spark.conf.get(key)).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that gives unused memory back when a task ends: workers are used again, and would keep their largest task's."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelattice/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few plain columns that may be held by the driver or broadcast: some MB.
SMALL = 1 << 18


def if_small(df: DataFrame, small: int = SMALL) -> DataFrame:
    """A written table of few short columns, marked for broadcast if it has at most `small` rows."""
    return F.broadcast(df) if df.count() <= small else df


def written() -> int:
    """How many tables have been written so far; a mark for release()."""
    return len(_written)


def release(start: int, stop: int) -> None:
    """Delete the tables with the numbers start <= n < stop. Only for those that no DataFrame still to be computed reads."""
    for spark, path in _written[start:stop]:
        if path:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written[start:stop] = [(spark, "") for spark, _ in _written[start:stop]]


@atexit.register
def _clean() -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        release(0, len(_written))


def join_by_size(left: DataFrame, right: DataFrame, keys: list[str], size: str, rows: int, hot_keys: int = 4096) -> DataFrame:
    """Left join of `left` to one `right` row per key, where `size` says how many left rows the key has.

    Keys with more than rows / hot_keys left rows are fewer than hot_keys by counting, so that part of `right`
    has a proven bound and is broadcast; only rows of the other keys are shuffled, and none of those keys is large.
    """
    limit = max(1000, rows // hot_keys)
    hot = right.filter(F.col(size) > limit)
    cold = right.filter(F.col(size) <= limit)
    first = left.join(F.broadcast(hot), keys, "left")
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return first.filter(F.col(size).isNotNull()).unionByName(rest)
