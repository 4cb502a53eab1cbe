"""Query text to tree, as text again; and what must be refused."""

import pytest

from tidelattice.model import QueryError
from tidelattice.plans.parser import Binary, Number, Selector, duration, parse, show
from tidelattice.plans.rewrite import AggregationRule, folded, histogram_names, preaggregated

GOLDEN = {
    "a + b * c": "(a + (b * c))",
    "a ^ b ^ c": "(a ^ (b ^ c))",
    "-a ^ 2": "(0.0 - (a ^ 2.0))",
    "a or b and c unless d": "(a or ((b and c) unless d))",
    "a == bool 1": "(a == bool 1.0)",
    'm{x="1",y!~"b|c"}': 'm{x="1",y!~"b|c"}',
    "{__name__='m'}": "m",
    "m::sum[5m]": "m::sum[300000ms]",
    "m:::x": "m:::x",
    "m[1h30m] offset 1w": "m[5400000ms] offset 604800000ms",
    "m[2i]": "m[2.0i]",
    "m @ end()": "m @ end()",
    "m @ 100 offset -5m": "m @ 100.0 offset -300000ms",
    "sum(m) by (a, b)": "sum by (a, b) (m)",
    "sum without (a) (m)": "sum without (a) (m)",
    "topk(3, m)": "topk (3.0, m)",
    'count_values("v", m)': 'count_values ("v", m)',
    "a * on (x) group_left (y) b": "(a * on (x) group_left (y) b)",
    "a / ignoring (x) group_right b": "(a / ignoring (x) group_right () b)",
    "rate(m[5m])[1h:10m]": "rate(m[300000ms])[3600000ms:600000ms]",
    "max_over_time(m[1h:])": "max_over_time(m[3600000ms:])",
    "a + b LIMIT 5": "(a + b) limit 5",
    "histogram_quantile(0.9, sum(rate(m[5m])) by (le))": "histogram_quantile(0.9, sum by (le) (rate(m[300000ms])))",
    "SUM(m) # a comment": "sum (m)",
    "0x1F + 1e3 + 2.": "((31.0 + 1000.0) + 2.0)",
    "Inf": "inf",
    "label_replace(m, 'a', \"$1\\n\", 'b', '(.*)')": 'label_replace(m, "a", "$1\\n", "b", "(.*)")',
    "and:x{group='1'}": 'and:x{group="1"}',
    "m[1y]": "m[31449600000ms]",
}


@pytest.mark.parametrize("text", GOLDEN)
def test_golden(text):
    got = show(parse(text))
    assert got == GOLDEN[text]
    assert show(parse(got)) == got


@pytest.mark.parametrize(
    "text",
    [
        "", "a +", "m{", "m{a}", '{a="b"}', 'm{__name__="n"}', "m[5m] + ", "sum()", "topk(m)", "nope(m)", "rate(m)", "abs(m[5m])", "1 > 2", "1 and m", "m[5x]", "m{a=b}", "'\\q'", "m bool 1", "a + bool b",
        "m @ now()", "1 offset 5m", "holt_winters(m[5m], 2, 0.5)", "a and on (x) group_left b", "a + on (x) group_left (x) b", "count_values(1, m)", "quantile('a', m)", "label_replace(m, 1, 'a', 'b', 'c')", 'm{a=~"' + "x.*" * 400 + '"}',
    ],
)
def test_refused(text):
    with pytest.raises(QueryError):
        parse(text)


def test_long_alternations_are_allowed():
    assert parse('m{a=~"' + "|".join(f"v{i}" for i in range(900)) + '"}')


def test_durations():
    assert duration("1d12h") == (129_600_000, 0.0) and duration("1.5h")[0] == 5_400_000 and duration("3i") == (0, 3.0)


def test_folding():
    assert folded(parse("2 ^ 3 ^ 0 + 7 % 4")) == Number(5.0)
    assert folded(parse("1 / 0")).value == float("inf") and folded(parse("0 / 0")).value != folded(parse("0 / 0")).value
    assert isinstance(folded(parse("m * (2 + 3)")), Binary) and show(folded(parse("m * (2 + 3)"))) == "(m * 5.0)"


def test_histogram_names():
    f = lambda t: show(histogram_names(parse(t), lambda m: m == "known_sum", lambda m: m == "h"))
    assert f('h_bucket{le="5",a="b"}') == 'h{a="b",_bucket_="5"}'
    assert f("rate(h_sum[5m])") == "rate(h::sum[300000ms])" and f("h_count") == "h::count"
    assert f("known_sum") == "known_sum" and f("x_sum") == "x_sum"


def test_preaggregation():
    rules = [AggregationRule("m", "m:agg", frozenset({"a", "b"}))]
    f = lambda t: show(preaggregated(parse(t), rules))
    assert f("optimize_with_agg(sum by (a) (rate(m[5m])))") == "sum by (a) (rate(m:agg::sum[300000ms]))"
    assert f("optimize_with_agg(sum by (a) (count_over_time(m[5m])))") == "sum by (a) (sum_over_time(m:agg::count[300000ms]))"
    assert f("optimize_with_agg(sum by (c) (rate(m[5m])))") == "sum by (c) (rate(m[300000ms]))"
    assert f('optimize_with_agg(sum(rate(m{c="1"}[5m])))') == 'sum (rate(m{c="1"}[300000ms]))'
    assert f("sum by (a) (rate(m[5m]))") == "sum by (a) (rate(m[300000ms]))"
    assert f("optimize_with_agg(no_optimize(sum(rate(m[5m]))))") == "sum (rate(m[300000ms]))"
    assert f("optimize_with_agg(avg(rate(m[5m])))") == "avg (rate(m[300000ms]))"


def test_selector_fields():
    s = parse("a.b-c:d{x='1'}[5m] @ start()")
    assert isinstance(s, Selector) and s.metric == "a.b-c:d" and s.window == 300_000 and s.at == "start"
