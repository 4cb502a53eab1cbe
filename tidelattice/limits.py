"""Limits on what a query may touch, and figures of what it did touch."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .model import TS, VALUE, Config, LimitError, Vector


@dataclass(frozen=True)
class Probe:
    """Series that may be at most `limit`."""

    what: str
    vector: Vector
    limit: int

    def check(self) -> None:
        """Distinct series are counted up to the limit only."""
        found = self.vector.df.select(*self.vector.labels).distinct().limit(self.limit + 1).count()
        if found > self.limit:
            raise LimitError(f"{self.what}: more than {self.limit}")


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of the files that the plan reads after folders were pruned, as Spark estimates them; no job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def enforce(df: DataFrame, probes: list[Probe], config: Config) -> DataFrame:
    """The result, or LimitError. Cheap checks come first; each probe, and the count of result samples, is a job of its own that stops at its limit."""
    if config.scan_bytes_limit is not None and (n := scanned_bytes(df)) > config.scan_bytes_limit:
        raise LimitError(f"the query reads {n} bytes, more than {config.scan_bytes_limit}")
    for p in probes:
        p.check()
    if df.limit(config.sample_limit + 1).count() > config.sample_limit:
        raise LimitError(f"the result has more than {config.sample_limit} samples")
    return df


def observed(o: Observation) -> dict[str, int]:
    """The figures of an observation; nothing was read where adaptive execution left a part of the plan out."""
    return o.get if o._jo.getRow().length() else {"samples": 0, "series": 0}


@dataclass
class Stats:
    """Figures gathered while a query's result is computed; ask for them after an action on it."""

    config: Config
    reads: list[tuple[str, Observation]] = field(default_factory=list)
    result: Observation | None = None
    scanned_bytes: int = 0

    def reading(self, metric: str, v: Vector) -> Vector:
        """Count a selector's samples (buckets, for histograms) and about how many series they belong to."""
        o = Observation()
        self.reads.append((metric, o))
        series = F.approx_count_distinct(F.struct(*v.labels)) if v.labels else F.lit(1)
        return v.with_df(v.df.observe(o, F.count(F.lit(1)).alias("samples"), series.alias("series")))

    def returning(self, df: DataFrame) -> DataFrame:
        self.scanned_bytes, self.result = scanned_bytes(df), Observation()
        finite = F.count_if(~F.isnan(VALUE)) if VALUE in df.columns else F.count(F.lit(1))
        labels = [c for c in df.columns if c not in (TS, VALUE, "les", "counts", "max", "min")]
        series = F.approx_count_distinct(F.struct(*labels)) if labels else F.lit(1)
        return df.observe(self.result, finite.alias("samples"), series.alias("series"))

    def figures(self) -> dict[str, int]:
        """samples_scanned, series_scanned (about), result_samples, result_series (about), scanned_bytes."""
        read = [observed(o) for _, o in self.reads]
        result = observed(self.result)
        return {
            "samples_scanned": sum(r["samples"] for r in read),
            "series_scanned": sum(r["series"] for r in read),
            "result_samples": result["samples"],
            "result_series": result["series"],
            "scanned_bytes": self.scanned_bytes,
        }

    def warnings(self) -> list[str]:
        """Limits that the query went beyond without being refused."""
        got, c = self.figures(), self.config
        limits = {"samples_scanned": c.sample_limit, "result_samples": c.sample_limit, "scanned_bytes": c.scan_bytes_limit}
        return [f"{k} {got[k]} is more than {n}" for k, n in limits.items() if n is not None and got[k] > n]
