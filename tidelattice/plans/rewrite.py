"""Rewrites of the syntax tree that no optimizer of DataFrames could know: pre-aggregated metrics, and histogram naming."""

from __future__ import annotations

from dataclasses import dataclass, replace

from .parser import Aggregate, Binary, Call, Limit, Matcher, Node, Number, Selector, Subquery

#: Aggregations of a function that a pre-aggregated metric can answer, with the column that holds it.
PREAGGREGATED = {
    ("sum", "rate"): "sum",
    ("sum", "increase"): "sum",
    ("sum", "sum_over_time"): "sum",
    ("sum", "count_over_time"): "count",
    ("min", "min_over_time"): "min",
    ("max", "max_over_time"): "max",
}


@dataclass(frozen=True)
class AggregationRule:
    """metric has a version with another suffix in which only some labels are kept."""

    metric: str
    aggregated: str
    kept: frozenset[str]


def children(n: Node, f) -> Node:
    match n:
        case Aggregate() | Limit() | Subquery():
            return replace(n, inner=f(n.inner))
        case Call():
            return replace(n, args=tuple(f(a) for a in n.args))
        case Binary():
            return replace(n, left=f(n.left), right=f(n.right))
    return n


def preaggregated(n: Node, rules: list[AggregationRule], active: bool = False) -> Node:
    """Within optimize_with_agg(), use the pre-aggregated metric where grouping and matchers need only labels it keeps."""
    if isinstance(n, Call) and n.name == "no_optimize":
        return n.args[0]
    if isinstance(n, Call) and n.name == "optimize_with_agg":
        return preaggregated(n.args[0], rules, True)
    if active and isinstance(n, Aggregate) and n.without is None and isinstance(n.inner, Call) and (n.op, n.inner.name) in PREAGGREGATED and isinstance(n.inner.args[0], Selector):
        s = n.inner.args[0]
        needed = {*(n.by or ()), *(m.label for m in s.matchers)}
        for r in rules:
            if r.metric == s.metric and needed <= r.kept:
                name = "sum_over_time" if n.inner.name == "count_over_time" else n.inner.name
                column = PREAGGREGATED[n.op, n.inner.name]
                return replace(n, inner=Call(name, (replace(s, metric=r.aggregated, column=column),)))
    return children(n, lambda x: preaggregated(x, rules, active))


def histogram_names(n: Node, known, histograms) -> Node:
    """metric_bucket{le="x"}, metric_sum and metric_count of a metric that is stored as a histogram."""
    if isinstance(n, Selector) and n.metric and not known(n.metric):
        for suffix in ("_bucket", "_sum", "_count"):
            base = n.metric.removesuffix(suffix)
            if base != n.metric and histograms(base):
                if suffix != "_bucket":
                    return replace(n, metric=base, column=suffix[1:])
                le = next((m for m in n.matchers if m.label == "le" and m.op == "="), None)
                rest = tuple(m for m in n.matchers if m is not le)
                return replace(n, metric=base, matchers=rest + ((Matcher("_bucket_", "=", le.value),) if le else ()))
    return children(n, lambda x: histogram_names(x, known, histograms))


def folded(n: Node) -> Node:
    """Arithmetic of numbers done at once."""
    from ..functions.instant import fold

    n = children(n, folded)
    if isinstance(n, Binary) and isinstance(n.left, Number) and isinstance(n.right, Number):
        return Number(fold(n.op, n.left.value, n.right.value))
    return n
