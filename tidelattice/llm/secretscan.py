"""Secret scanning: fixed patterns, and formats inferred from labelled credentials as probabilistic automata.

The credentials of a kind form a prefix tree with frequencies. Its states are merged red-blue fashion, from the root on, wherever two
states' next characters, ends, and numbers of characters still to come agree within a Hoeffding bound, all the way down (grammar inference by
state merging). States of one depth may agree on little evidence; states of different depths need `least` visits each, so that a format keeps its
length and the places of its parts unless the data show that it repeats itself. The result is a deterministic probabilistic automaton.

Every token of six or more characters is scored: its log-likelihood under the automata of credentials against that of ordinary tokens. Those are
automata inferred in the same way from made numbers, dates and uuids, and a model of words, numbers, short hexadecimal runs and separators, whose pairs of letters come from
the corpus. Tokens likelier as a credential by `margin` nats are reported as
kind `format`, unless they touch a span that a pattern has found.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Texts are scanned whole, however long, in time that grows as their
length does; what trains is bounded in characters. Ties between formats do not matter, as
only the best likelihood counts. Repeated rows are scanned each, repeated credentials train once. An empty table gives an empty result, and a model of the made credentials alone.
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import heapq
import math
import random
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import lean, materialise, small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "format")
LEAST = {"assign": 6, "access": 20}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns, sorted; an assignment's span is its value's."""
    out = []
    low = text.lower() if text.isascii() else None
    if low is None or any(w in low for w in WORDS):
        out += [(m.start(2), 0, m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


FLOOR = math.log(1e-6)


class Automaton:
    """A deterministic probabilistic automaton: per state a map from character to (next state, log probability), the log probability to end,
    and (next state, log of the weight) for characters not seen there, which have the log probabilities of `anywhere` besides."""

    def __init__(self, moves: list[dict[str, tuple[int, float]]], ends: list[float], other: list[tuple[int, float]], anywhere: dict[str, float]):
        self.moves, self.ends, self.other, self.anywhere = moves, ends, other, anywhere
        self._best: list[float] = []

    def log_likelihood(self, s: str) -> float:
        at, total = 0, 0.0
        for c in s:
            got = self.moves[at].get(c)
            if got is None:
                nxt, lp = self.other[at]
                lp += self.anywhere.get(c, FLOOR)
            else:
                nxt, lp = got
            at, total = nxt, total + lp
        return total + self.ends[at]

    def best(self, length: int) -> float:
        """The highest log-likelihood of any string of that length."""
        if not self._best:
            top = max(self.anywhere.values(), default=FLOOR)
            steps = [{} for _ in self.moves]
            for k, own in enumerate(self.moves):
                to, lp = self.other[k]
                steps[k][to] = lp + top
                for to, lp in own.values():
                    steps[k][to] = max(lp, steps[k].get(to, -math.inf))
            at = {0: 0.0}
            for _ in range(LONGEST + 1):
                self._best.append(max(v + self.ends[k] for k, v in at.items()))
                after: dict[int, float] = {}
                for k, v in at.items():
                    for to, lp in steps[k].items():
                        after[to] = max(v + lp, after.get(to, -math.inf))
                at = after
        return self._best[length]


#: Length up to which the best likelihoods are tabled.
LONGEST = 256


def infer(samples: Iterable[str], alpha: float = 0.01, least: int = 100) -> Automaton:
    """Merge the states of the samples' prefix tree; two states agree if their frequencies differ less than the Hoeffding bound at alpha."""
    child: list[dict[str, int]] = [{}]
    arcs: list[dict[str, int]] = [{}]
    rest: list[dict[int, int]] = [{}]  # how many samples have how many characters still to come
    final, visits, depth = [0], [0], [0]
    seen_chars: dict[str, int] = {}
    for s in samples:
        at = 0
        visits[0] += 1
        rest[0][len(s)] = rest[0].get(len(s), 0) + 1
        for i, c in enumerate(s):
            seen_chars[c] = seen_chars.get(c, 0) + 1
            if c not in child[at]:
                child[at][c] = len(child)
                child.append({})
                arcs.append({})
                rest.append({})
                final.append(0)
                visits.append(0)
                depth.append(i + 1)
            arcs[at][c] = arcs[at].get(c, 0) + 1
            at = child[at][c]
            visits[at] += 1
            left = len(s) - i - 1
            rest[at][left] = rest[at].get(left, 0) + 1
        final[at] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def alike(x: dict, n: int, y: dict, m: int, most: float) -> bool:
        return all(abs(x.get(k, 0) / n - y.get(k, 0) / m) <= most for k in (x if len(x) >= len(y) else y)) and all(abs(x.get(k, 0) / n - y.get(k, 0) / m) <= most for k in (y if len(x) >= len(y) else x))

    def agree(p: int, q: int) -> bool:
        todo = [(p, q)]
        seen = set()
        while todo:
            p, q = todo.pop()
            if p == q or (p, q) in seen:
                continue
            seen.add((p, q))
            n, m = visits[p], visits[q]
            most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if most >= 1:  # too little evidence to tell them apart, and less below
                continue
            if abs(final[p] / n - final[q] / m) > most or not alike(arcs[p], n, arcs[q], m, most) or not alike(rest[p], n, rest[q], m, most):
                return False
            todo += [(child[p][c], child[q][c]) for c in child[p].keys() & child[q].keys()]
        return True

    red: set[int] = {0}
    order = [0]
    by_depth: dict[int, list[int]] = {0: [0]}
    heap: list[tuple[int, int, int, str]] = []

    def push(p: int, c: str) -> None:
        q = child[p][c]
        heapq.heappush(heap, (depth[q], -visits[q], p, c))

    def fold(p: int, q: int) -> None:
        """Add the tree below q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            visits[p] += visits[q]
            final[p] += final[q]
            for k, n in rest[q].items():
                rest[p][k] = rest[p].get(k, 0) + n
            for c, to in child[q].items():
                arcs[p][c] = arcs[p].get(c, 0) + arcs[q][c]
                if c in child[p]:
                    todo.append((child[p][c], to))
                else:
                    child[p][c] = to
                    if p in red:
                        push(p, c)

    for c in child[0]:
        push(0, c)
    while heap:
        d, _, p, c = heapq.heappop(heap)
        q = child[p][c]
        if q in red:
            continue
        same = by_depth.get(d, [])
        into = next((r for r in same if agree(r, q)), None)
        if into is None and visits[q] >= least:
            into = next((r for r in order if visits[r] >= least and r not in same and agree(r, q)), None)
        if into is None:
            red.add(q)
            order.append(q)
            by_depth.setdefault(d, []).append(q)
            for x in child[q]:
                push(q, x)
        else:
            child[p][c] = into
            fold(into, q)
    number = {r: i for i, r in enumerate(order)}
    total = sum(seen_chars.values()) + 1
    anywhere = {c: math.log(n / total) for c, n in seen_chars.items()}
    moves, ends, other = [], [], []
    for r in order:
        # one further visit's weight goes to the characters of the whole format, and a little to an end never seen
        n = visits[r] + 1.0002
        moves.append({c: (number[to], math.log((arcs[r][c] + math.exp(anywhere[c])) / n)) for c, to in child[r].items()})
        ends.append(math.log((final[r] + 0.0002) / n))
        likeliest = max(child[r], key=lambda c, r=r: (arcs[r][c], c), default=None)
        other.append((number[child[r][likeliest]] if likeliest else number[r], -math.log(n) if likeliest else FLOOR))
    return Automaton(moves, ends, other, anywhere)


_infer_made = functools.lru_cache(maxsize=64)(infer)
_RUNS = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_ALNUM_RUNS = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
_HEXES = re.compile(r"[0-9a-f]+|[0-9A-F]+")


class OrdinaryTokens:
    """Log-likelihood of ordinary tokens: words (pairs of letters and their case), numbers, short hexadecimal runs, and separators."""

    def __init__(self, pairs: dict[str, int]):
        """pairs: how often a lower-case letter follows another; ^ before the first of a run, $ after the last."""
        before: dict[str, int] = {}
        letters: dict[str, int] = {}
        for xy, n in pairs.items():
            before[xy[0]] = before.get(xy[0], 0) + n
            letters[xy[1]] = letters.get(xy[1], 0) + n
        alphabet = "abcdefghijklmnopqrstuvwxyz"
        total = sum(letters.values()) + 27
        single = {y: (letters.get(y, 0) + 1) / total for y in alphabet + "$"}
        # pairs seen rarely fall back on single letters, which a tenth of the weight is kept for
        self.pairs = {(x, y): math.log(0.9 * pairs.get(x + y, 0) / max(before.get(x, 0), 1) + 0.1 * single[y] if before.get(x) else single[y]) for x in "^" + alphabet for y in alphabet + "$"}

    def _letters(self, s: str) -> float:
        low = s.lower()
        out = sum(map(self.pairs.__getitem__, zip("^" + low, low + "$")))  # noqa: B905  of one length
        if s.islower():
            return out - 0.3
        if s.isupper() or (s[0].isupper() and s[1:].islower()):
            return out - 2.0
        return out - 3.0 - 2.0 * sum(s[i].islower() != s[i + 1].islower() for i in range(len(s) - 1))

    def log_likelihood(self, token: str) -> float:
        if token.isalpha():
            return self._letters(token)
        total = 0.0
        for run in _ALNUM_RUNS.findall(token):
            if not run.isalnum():
                total -= 3.0
                continue
            parts = _RUNS.findall(run)
            plain = -2.3 * (len(parts) - 1) + sum(-2.0 - 2.4 * len(x) if x[0].isdigit() else self._letters(x) for x in parts)
            if len(parts) > 1 and _HEXES.fullmatch(run):
                plain = max(plain, -4.6 - 3.0 * len(run))
            total += plain
        return total


class SecretModel:
    """Automata of credentials by kind, and of ordinary tokens by kind, and the model of other ordinary tokens."""

    #: Tokens whose scores are remembered at once, to score a frequent word once.
    REMEMBERED = 1 << 17

    def __init__(self, automata: dict[str, Automaton], ordinary: dict[str, Automaton], words: OrdinaryTokens, margin: float = 8.0):
        self.automata, self.ordinary, self.words, self.margin = automata, ordinary, words, margin
        self._known: dict[str, bool] = {}
        #: by length, the highest log-likelihood of any string as a credential
        self._most = [max((a.best(k) for a in automata.values()), default=-math.inf) for k in range(LONGEST + 1)]

    def score(self, token: str) -> float:
        """Nats by which the token is likelier as a credential of the best kind than as an ordinary token of the best kind; -inf without automata."""
        plain = max(self.words.log_likelihood(token), max((a.log_likelihood(token) for a in self.ordinary.values()), default=-math.inf))
        return max((a.log_likelihood(token) for a in self.automata.values()), default=-math.inf) - plain

    def likely(self, token: str) -> bool:
        """Whether the token is reported."""
        known = self._known.get(token)
        if known is None:
            # no string of this length is likely enough as a credential to beat this one as words: the score cannot reach the margin
            most = self._most[len(token)] if len(token) <= LONGEST else math.inf
            known = most - self.words.log_likelihood(token) >= self.margin and self.score(token) >= self.margin
            if len(token) <= 64:
                if len(self._known) >= self.REMEMBERED:
                    self._known.clear()
                self._known[token] = known
        return known

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The fixed patterns' spans, and all spans."""
        base = base_spans(text)
        more = []
        k = reach = 0  # how many base spans begin before the token's end, and where the last of them ends
        for m in TOKEN.finditer(text):
            a, b = m.span()
            while k < len(base) and base[k][0] < b:
                reach = max(reach, base[k][2])
                k += 1
            if reach <= a and self.likely(m.group()):
                more.append((a, 3, b))
        return base, sorted(base + more)


_UPPER32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_ALNUM62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def seed_credentials(n: int = 600, seed: int = 5) -> list[tuple[str, str]]:
    """Labelled credentials made by rule, n a kind, for formats that a corpus may lack: AKIA and 16 capitals or digits; base-64 keys of 40;
    hex of 32, 40 and 64 in either case; prefixed tokens of several services; and random letters and digits of 10 to 24."""
    r = random.Random(seed)
    take = lambda alphabet, k: "".join(r.choices(alphabet, k=k))
    out = []
    for i in range(n):
        out += [
            ("access", "AKIA" + take(_UPPER32, 16)),
            ("key", take(_ALNUM62 + "+/", 40)),
            ("hex", take("0123456789abcdef", (32, 40, 64)[i % 3])),
            ("HEX", take("0123456789ABCDEF", (32, 40, 64)[i % 3])),
            ("prefixed-36", "ghp_" + take(_ALNUM62, 36)),
            ("prefixed-24", "sk_live_" + take(_ALNUM62, 24)),
            ("prefixed-35", "AIza" + take(_ALNUM62 + "_-", 35)),
            ("short", take(_ALNUM62, r.randint(10, 24))),
        ]
    return out


def seed_ordinary(n: int = 600, seed: int = 6) -> list[tuple[str, str]]:
    """Ordinary tokens made by rule, n a kind: numbers, dates and times, uuids."""
    r = random.Random(seed)
    take = lambda alphabet, k: "".join(r.choices(alphabet, k=k))
    out = []
    for i in range(n):
        h = take("0123456789abcdef" if i % 4 else "0123456789ABCDEF", 32)
        day = f"{r.randint(1970, 2039)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"
        out += [
            ("number", take("0123456789", r.randint(6, 24))),
            ("date", day + ("", f"T{r.randint(0, 23):02}", f"_{r.randint(0, 23):02}-{r.randint(0, 59):02}")[i % 3]),
            ("uuid", f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"),
        ]
    return out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over texts: (kind, value) of credentials that the patterns find, and ordinary tokens as kind `ordinary`."""
    for b in batches:
        kinds, values = [], []
        for text in b.column(0).to_pylist():
            if not text:
                continue
            found = base_spans(text)
            for s, k, e in found:
                kinds.append(KINDS[k])
                values.append(text[s:e])
            if not found:
                for m in TOKEN.finditer(text):
                    kinds.append("ordinary")
                    values.append(m.group())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "value"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over tokens: how often each lower-cased letter follows another, ^ before the first of a run and $ after the last."""
    for b in batches:
        n: dict[str, int] = {}
        for v in b.column(0).to_pylist():
            for run in re.findall("[a-z]+", v.lower()):
                for x, y in zip("^" + run, run + "$", strict=True):
                    n[x + y] = n.get(x + y, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["pair", "n"])


#: Longest value that trains an automaton, and characters a kind that do on average over per_kind values: a prefix tree has a node for each.
TRAINED, TRAINED_ON_AVERAGE = 4096, 256


def train(docs: DataFrame, per_kind: int = 600, sample_docs: int = 20000) -> SecretModel:
    """Automata from credentials labelled by the patterns in a bounded sample of documents (the sample_docs of least hash; of each kind about per_kind
    distinct values of at most TRAINED characters, fewer if they have over TRAINED_ON_AVERAGE characters on average: those whose hash is under per_kind /
    (their number)) and from all of seed_credentials(); letter pairs come from all distinct tokens of the same sample."""
    sample = docs.select("doc_id", "text").filter("text is not null").orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(sample_docs)
    texts = small_batches(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left_semi").select("text")
    values = materialise(texts.mapInArrow(lean(_labelled), "kind string, value string").distinct(), "secret-values")
    found = values.filter(f"kind != 'ordinary' and length(value) <= {TRAINED}")
    by_length = F.lit(float(per_kind * TRAINED_ON_AVERAGE)) / F.sum(F.length("value"))
    part = found.groupBy("kind").agg(F.least(F.lit(float(per_kind)) / F.count("*"), by_length).alias("part"))
    # a row for each of three kinds
    drawn = found.join(F.broadcast(part), "kind").filter(F.shiftrightunsigned(F.xxhash64("value"), 11).cast("double") / float(1 << 53) < F.col("part"))
    got: dict[str, set[str]] = {}
    for r in drawn.select("kind", "value").toArrow().to_pylist():
        got.setdefault(r["kind"], set()).add(r["value"])
    pairs = values.filter("kind = 'ordinary'").select("value").mapInArrow(lean(_pairs), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return fit(got, {r["pair"]: r["n"] for r in pairs})


def fit(values: dict[str, set[str]], pairs: dict[str, int]) -> SecretModel:
    """The model of labelled values by kind, with the made ones, and of pairs of letters of ordinary tokens."""
    made: dict[str, list[str]] = {}
    for kind, value in seed_credentials():
        made.setdefault(kind, []).append(value)
    ordinary: dict[str, list[str]] = {}
    for kind, value in seed_ordinary():
        ordinary.setdefault(kind, []).append(value)
    automata = {k: _infer_made((*sorted(values.get(k, ())), *made.get(k, ()))) for k in sorted(values.keys() | made.keys())}
    return SecretModel(automata, {k: _infer_made(tuple(v)) for k, v in sorted(ordinary.items())}, OrdinaryTokens(pairs))


def scan(docs: DataFrame, model: SecretModel) -> DataFrame:
    """One row per document: doc_id, spans and base_spans as arrays of (kind, start, end)."""
    held = small_batches(docs).sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, every = [], []
            for text in b.column(1):
                x, y = held.value.spans(text.as_py() or "")
                base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x])
                every.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in y])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(span)), pa.array(every, pa.list_(span))], ["doc_id", "base_spans", "spans"])

    s = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, base_spans {s}, spans {s}")
