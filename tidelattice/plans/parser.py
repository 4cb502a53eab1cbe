"""Query text to syntax tree: a lexer and a precedence-climbing parser."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from ..model import Config, QueryError

#: Operators by how tightly they bind, weakest first.
PRECEDENCE = [{"or"}, {"and", "unless"}, {"==", "!=", "<=", "<", ">=", ">"}, {"+", "-"}, {"*", "/", "%"}, {"^"}]
LEVEL = {op: i for i, ops in enumerate(PRECEDENCE) for op in ops}
COMPARISONS, SET_OPS, ARITHMETIC = PRECEDENCE[2], {"and", "or", "unless"}, {"+", "-", "*", "/", "%", "^"}
#: Milliseconds of the duration units; a year is 52 weeks.
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_449_600_000}
AGGREGATES = ("sum", "avg", "min", "max", "count", "group", "stddev", "stdvar", "topk", "bottomk", "quantile", "count_values")
WITH_PARAMETER = ("topk", "bottomk", "quantile", "count_values")

#: The functions, with the kinds of their arguments: v instant vector, r range, s scalar, t string, ? optional, * repeated.
FUNCTIONS = {
    **dict.fromkeys(("abs", "ceil", "floor", "exp", "sqrt", "ln", "log10", "log2", "sgn", "sort", "sort_desc", "absent", "scalar", "timestamp", "hist_to_prom_vectors", "optimize_with_agg", "no_optimize", "chunk_meta"), "v"),
    **dict.fromkeys(("year", "month", "day_of_month", "day_of_week", "hour", "minute", "days_in_month"), "v?"),
    **dict.fromkeys(("rate", "increase", "delta", "irate", "idelta", "deriv", "resets", "changes", "sum_over_time", "avg_over_time", "count_over_time", "min_over_time", "max_over_time", "stddev_over_time", "stdvar_over_time", "last_over_time", "mad_over_time", "z_score", "present_over_time", "absent_over_time"), "r"),
    **dict.fromkeys(("clamp_min", "clamp_max", "or_vector"), "vs"),
    "round": "vs?",
    "time": "",
    "vector": "s",
    "predict_linear": "rs",
    "quantile_over_time": "sr",
    "holt_winters": "rss",
    "last_over_time_is_mad_outlier": "ssr",
    "histogram_quantile": "sv",
    "histogram_max_quantile": "sv",
    "histogram_max_quantile_even": "stv",
    "histogram_fraction": "ssv",
    "histogram_bucket": "sv",
    "label_replace": "vtttt",
    "label_join": "vttt*",
    "limit": "sv",
}
RANGE_FUNCTIONS = {f for f, a in FUNCTIONS.items() if "r" in a}


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Number(Node):
    value: float


@dataclass(frozen=True)
class Text(Node):
    value: str


@dataclass(frozen=True)
class Matcher(Node):
    label: str
    op: str
    value: str


@dataclass(frozen=True)
class Selector(Node):
    metric: str | None
    matchers: tuple[Matcher, ...]
    window: int | None = None  # ms
    window_steps: float = 0.0  # plus so many steps
    offset: int = 0
    at: str | float | None = None
    column: str | None = None


@dataclass(frozen=True)
class Subquery(Node):
    inner: Node
    window: int
    step: int | None
    offset: int = 0
    at: str | float | None = None


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Aggregate(Node):
    op: str
    inner: Node
    param: Node | None = None
    by: tuple[str, ...] | None = None
    without: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node
    bool_: bool = False
    on: tuple[str, ...] | None = None
    ignoring: tuple[str, ...] = ()
    group: str | None = None  # left or right
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Limit(Node):
    n: int
    inner: Node


@dataclass
class Token:
    kind: str
    text: str
    at: int


_LEX = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<duration>(?:\d+(?:\.\d+)?(?:ms|[smhdwy]))+(?![A-Za-z0-9_])|\d+(?:\.\d+)?i(?![A-Za-z0-9_]))
    |(?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    |(?P<name>(?:[A-Za-z_]|:(?=[A-Za-z_:]))[A-Za-z0-9_:.\-]*)
    |(?P<op>==|!=|<=|>=|=~|!~|[-+*/%^<>=(){}\[\],:@])""",
    re.VERBOSE | re.DOTALL,
)
_KEYWORDS = {"and", "or", "unless", "by", "without", "on", "ignoring", "group_left", "group_right", "bool", "offset", "limit"}
_ESCAPES = {"\\": "\\", "'": "'", '"': '"', ".": ".", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def unquote(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1] not in _ESCAPES:
            raise QueryError(f"no escape \\{m[1]}")
        return _ESCAPES[m[1]]

    return re.sub(r"\\(.)", one, text[1:-1], flags=re.DOTALL)


def lex(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at]!r} at {at}")
        kind = m.lastgroup
        word = m.group()
        # a name swallows '-' and '.'; give back what is an operator with its operand, as in a-1 or x -y
        if kind == "name" and "-" in word and word.split("-", 1)[0].lower() in _KEYWORDS:
            word = word.split("-", 1)[0]
        if kind != "skip":
            out.append(Token(kind, word, at))
        at += len(word)
    out.append(Token("end", "", at))
    return out


def duration(text: str) -> tuple[int, float]:
    """Milliseconds, and the number of steps of an `i` duration."""
    if text.endswith("i"):
        return 0, float(text[:-1])
    return round(sum(float(n) * UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ms|[smhdwy])", text))), 0.0


class Parser:
    def __init__(self, text: str, config: Config | None = None, functions: Mapping[str, str] | None = None):
        self.tokens, self.i, self.config = lex(text), 0, config or Config()
        self.functions = FUNCTIONS | dict(functions or {})

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def fail(self, what: str) -> QueryError:
        return QueryError(f"expected {what} at {self.now.at}, found {self.now.text or 'the end'!r}")

    def accept(self, *texts: str) -> str | None:
        t = self.now
        word = t.text.lower() if t.kind == "name" else t.text
        if t.kind in ("op", "name") and word in texts:
            self.i += 1
            return word
        return None

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise self.fail(repr(text))

    def parse(self) -> Node:
        node = self.binary(0)
        if self.now.kind != "end":
            raise self.fail("the end")
        return node

    def binary(self, least: int) -> Node:
        left = self.unary()
        while True:
            t = self.now
            op = t.text.lower() if t.kind == "name" else t.text
            if t.kind == "name" and op == "limit" and least == 0 and self.tokens[self.i + 1].kind == "number":
                left = Limit(int(float(self.tokens[self.i + 1].text)), left)
                self.i += 2
                continue
            if t.kind not in ("op", "name") or op not in LEVEL or LEVEL[op] < least:
                return left
            self.i += 1
            more: dict = {}
            if self.accept("bool"):
                if op not in COMPARISONS:
                    raise QueryError("bool goes with comparisons only")
                more["bool_"] = True
            if word := self.accept("on", "ignoring"):
                more[word] = self.names()
                if side := self.accept("group_left", "group_right"):
                    more["group"] = side[6:]
                    more["include"] = self.names() if self.now.text == "(" else ()
            right = self.binary(LEVEL[op] if op == "^" else LEVEL[op] + 1)
            left = self.checked(Binary(op, left, right, **more))

    def checked(self, b: Binary) -> Binary:
        scalar = [is_scalar(b.left), is_scalar(b.right)]
        if b.op in SET_OPS and any(scalar):
            raise QueryError(f"{b.op} needs vectors on both sides")
        if b.op in SET_OPS and b.group:
            raise QueryError("set operators take no grouping")
        if b.op in COMPARISONS and all(scalar) and not b.bool_:
            raise QueryError("comparisons between scalars need bool")
        if b.on is not None and set(b.on) & set(b.include):
            raise QueryError("a label cannot be matched on and included")
        if isinstance(b.left, Text) or isinstance(b.right, Text):
            raise QueryError("strings have no operators")
        return b

    def unary(self) -> Node:
        if op := self.accept("-", "+"):
            inner = self.binary(LEVEL["*"] + 1)
            if op == "+":
                return inner
            return Number(-inner.value) if isinstance(inner, Number) else Binary("-", Number(0.0), inner)
        return self.suffixes(self.primary())

    def suffixes(self, node: Node) -> Node:
        while True:
            if self.accept("["):
                ms, steps = self.duration()
                if self.accept(":"):
                    step = self.duration()[0] if self.now.kind == "duration" else None
                    self.expect("]")
                    node = Subquery(node, ms, step)
                else:
                    self.expect("]")
                    if not isinstance(node, Selector) or node.window is not None:
                        raise QueryError("a range goes with a selector; use [range:step] for other expressions")
                    node = replace(node, window=ms, window_steps=steps)
            elif self.accept("offset"):
                sign = -1 if self.accept("-") else 1
                if not isinstance(node, Selector | Subquery):
                    raise QueryError("offset goes with a selector or subquery")
                node = replace(node, offset=sign * self.duration()[0])
            elif self.accept("@"):
                if not isinstance(node, Selector | Subquery):
                    raise QueryError("@ goes with a selector or subquery")
                if word := self.accept("start", "end"):
                    self.expect("(")
                    self.expect(")")
                    node = replace(node, at=word)
                else:
                    sign = -1 if self.accept("-") else 1
                    if self.now.kind != "number":
                        raise self.fail("a time")
                    node = replace(node, at=sign * self.number(self.now.text))
                    self.i += 1
            else:
                return node

    def duration(self) -> tuple[int, float]:
        if self.now.kind != "duration":
            raise self.fail("a duration")
        self.i += 1
        return duration(self.tokens[self.i - 1].text)

    @staticmethod
    def number(text: str) -> float:
        return float(int(text, 16)) if text.lower().startswith("0x") else float(text)

    def names(self) -> tuple[str, ...]:
        self.expect("(")
        out = []
        while not self.accept(")"):
            if self.now.kind != "name":
                raise self.fail("a label")
            out.append(self.now.text)
            self.i += 1
            if self.now.text != ")":
                self.expect(",")
        return tuple(out)

    def primary(self) -> Node:
        t = self.now
        if t.kind == "number":
            self.i += 1
            return Number(self.number(t.text))
        if t.kind == "string":
            self.i += 1
            return Text(unquote(t.text))
        if self.accept("("):
            node = self.binary(0)
            self.expect(")")
            return node
        if t.text == "{":
            return self.selector(None)
        if t.kind != "name":
            raise self.fail("an expression")
        word, after = t.text.lower(), self.tokens[self.i + 1]
        if word in ("inf", "nan") and after.text not in ("{", "["):
            self.i += 1
            return Number(float(word))
        if word in AGGREGATES and (after.text == "(" or after.text.lower() in ("by", "without")):
            return self.aggregate(word)
        if after.text == "(":
            return self.call()
        self.i += 1
        return self.selector(t.text)

    def aggregate(self, op: str) -> Node:
        self.i += 1
        clause = self.clause()
        args = self.arguments()
        clause = clause or self.clause()
        if len(args) != (2 if op in WITH_PARAMETER else 1):
            raise QueryError(f"{op} takes {2 if op in WITH_PARAMETER else 1} arguments")
        if op in WITH_PARAMETER and not (isinstance(args[0], Text) if op == "count_values" else is_scalar(args[0])):
            raise QueryError(f"{op} needs a parameter first")
        return Aggregate(op, args[-1], args[0] if len(args) == 2 else None, **(clause or {}))

    def clause(self) -> dict | None:
        word = self.accept("by", "without")
        return {word: self.names()} if word else None

    def arguments(self) -> list[Node]:
        self.expect("(")
        out = []
        while not self.accept(")"):
            out.append(self.binary(0))
            if self.now.text != ")":
                self.expect(",")
        return out

    def call(self) -> Node:
        name = self.now.text.lower()
        if name not in self.functions:
            raise QueryError(f"no function {self.now.text}")
        self.i += 1
        args = self.arguments()
        kinds = re.findall(r"(\w)([?*]?)", self.functions[name])
        fewest, most = sum(not m for _, m in kinds), None if any(m == "*" for _, m in kinds) else len(kinds)
        if len(args) < fewest or (most is not None and len(args) > most):
            raise QueryError(f"{name} takes {fewest}{'' if most == fewest else ' or more'} arguments")
        for i, a in enumerate(args):
            kind = kinds[min(i, len(kinds) - 1)][0]
            ranged = isinstance(a, Subquery) or isinstance(a, Selector) and a.window is not None
            right = {"v": not is_scalar(a) and not isinstance(a, Text) and not (ranged and isinstance(a, Selector)), "r": ranged, "s": is_scalar(a), "t": isinstance(a, Text)}[kind]
            if not right:
                raise QueryError(f"argument {i + 1} of {name} is of the wrong kind")
        if name == "holt_winters" and any(isinstance(a, Number) and not 0 < a.value < 1 for a in args[1:]):
            raise QueryError("smoothing factors lie between 0 and 1")
        return Call(name, tuple(args))

    def selector(self, name: str | None) -> Node:
        matchers = []
        if self.accept("{"):
            while not self.accept("}"):
                if self.now.kind != "name":
                    raise self.fail("a label")
                label = self.now.text
                self.i += 1
                op = self.accept("=", "!=", "=~", "!~")
                if not op or self.now.kind != "string":
                    raise self.fail("a matcher")
                matchers.append(Matcher(label, op, unquote(self.now.text)))
                self.i += 1
                if self.now.text != "}":
                    self.expect(",")
        named = [m for m in matchers if m.label == "__name__"]
        if name is not None and named or len(named) > 1:
            raise QueryError("the metric is named twice")
        if name is None and not named:
            raise QueryError("a selector needs a metric name")
        if named and named[0].op == "=":
            name = named[0].value
            matchers = [m for m in matchers if m is not named[0]]
        for m in matchers:
            if m.op in ("=~", "!~"):
                special = re.search(r"[.+*?^$(){}\[\]\\]", m.value)
                if len(m.value) > (self.config.regex_limit if special else self.config.regex_or_limit):
                    raise QueryError(f"the pattern for {m.label} is too long")
        column = None
        if name and (cut := re.search(r"(?<!:)::(?!:)(?!.*(?<!:)::(?!:))", name)):
            name, column = name[: cut.start()], name[cut.end() :]
        return Selector(name, tuple(matchers), column=column)


def is_scalar(n: Node) -> bool:
    """Whether the node has one value per instant and no labels."""
    if isinstance(n, Number):
        return True
    if isinstance(n, Binary):
        return is_scalar(n.left) and is_scalar(n.right)
    if isinstance(n, Call):
        return n.name in ("time", "scalar") or FUNCTIONS.get(n.name) == "v?" and not n.args
    return False


def parse(text: str, config: Config | None = None, functions: Mapping[str, str] | None = None) -> Node:
    """functions: further names, with the kinds of their arguments as in FUNCTIONS."""
    return Parser(text, config, functions).parse()


def show(n: Node) -> str:
    """The node as query text, parenthesised throughout."""

    def tail(n) -> str:
        at = f" @ {n.at}()" if n.at in ("start", "end") else f" @ {n.at}" if n.at is not None else ""
        return at + (f" offset {'-' if n.offset < 0 else ''}{abs(n.offset)}ms" if n.offset else "")

    match n:
        case Number():
            return repr(n.value)
        case Text():
            return '"' + n.value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
        case Selector():
            inside = ",".join(f"{m.label}{m.op}{show(Text(m.value))}" for m in n.matchers)
            window = "" if n.window is None else f"[{n.window}ms]" if not n.window_steps else f"[{n.window_steps}i]"
            return f"{n.metric or ''}{'::' + n.column if n.column else ''}{'{' + inside + '}' if inside else ''}{window}{tail(n)}"
        case Subquery():
            return f"{show(n.inner)}[{n.window}ms:{'' if n.step is None else f'{n.step}ms'}]{tail(n)}"
        case Call():
            return f"{n.name}({', '.join(map(show, n.args))})"
        case Aggregate():
            clause = f" by ({', '.join(n.by)})" if n.by is not None else f" without ({', '.join(n.without)})" if n.without is not None else ""
            return f"{n.op}{clause} ({', '.join(show(x) for x in (n.param, n.inner) if x is not None)})"
        case Limit():
            return f"{show(n.inner)} limit {n.n}"
        case Binary():
            how = " bool" if n.bool_ else ""
            if n.on is not None:
                how += f" on ({', '.join(n.on)})"
            elif n.ignoring:
                how += f" ignoring ({', '.join(n.ignoring)})"
            if n.group:
                how += f" group_{n.group} ({', '.join(n.include)})"
            return f"({show(n.left)} {n.op}{how} {show(n.right)})"
    raise QueryError(f"cannot show {n}")
