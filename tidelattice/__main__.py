"""Command line over a sample store: python -m tidelattice STORE COMMAND ..."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .api import Engine
from .operators import metadata


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidelattice", description=__doc__)
    p.add_argument("store", help="folder that sources.store has written")
    p.add_argument("command", choices=["query", "explain", "list", "labels", "labelvalues", "series", "labelcardinality", "cardinality", "indexnames", "indexvalues", "stats"])
    p.add_argument("what", nargs="*", help="a query; a selector; or labels and a selector")
    p.add_argument("--start", type=int, default=int(time.time() * 1000))
    p.add_argument("--end", type=int)
    p.add_argument("--step", type=int, default=60_000)
    p.add_argument("--limit", type=int, default=100)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tidelattice").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    e = Engine(spark)
    e.register_store(a.store)
    end = a.start if a.end is None else a.end
    match a.command:
        case "list":
            print("\n".join(sorted(e.tables)))
            return
        case "explain":
            print(e.explain(a.what[0], a.start, end, a.step))
            return
        case "query":
            out = e.query(a.what[0], a.start) if end == a.start else e.query_range(a.what[0], a.start, end, a.step)
        case "labels":
            out = e.labels(a.what[0])
        case "indexnames":
            print("\n".join(sorted({x for ts in e.tables.values() for t in ts for x in t.labels})))
            return
        case "indexvalues":
            table, matchers = e._selected(a.what[1])
            out = metadata.value_frequencies(table, a.what[0], a.limit, matchers)
        case "stats":
            df, stats = e.with_stats(a.what[0], a.start, end, a.step if end > a.start else 0)
            df.write.format("noop").mode("overwrite").save()
            print("\n".join([f"{k}: {v}" for k, v in stats.figures().items()] + stats.warnings()))
            return
        case "labelvalues":
            out = e.label_values(a.what[:-1], a.what[-1])
        case "series":
            out = e.series(a.what[0], times=True)
        case "labelcardinality":
            out = metadata.label_cardinality(*e._selected(a.what[0]))
        case _:
            table, matchers = e._selected(a.what[-1])
            out = metadata.cardinalities(table, a.what[:-1], end, matchers=matchers)
    out.show(a.limit, truncate=False)


if __name__ == "__main__":
    main()
