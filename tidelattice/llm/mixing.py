"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by source, language and topic; raking scales the cells until each marginal has its target shares. Probabilities are
raked with their bound of 1: in each step cells that would exceed it are fixed at 1 and the other cells of the category take what
remains, so that the expected tokens of the sample meet budget and marginals wherever they can be met; what cannot be met is reported in `shares`. Each document is
drawn by its cell's probability and a uniform number hashed from its id.

Topics are spherical k-means clusters of hashed word counts: the rounds run over all documents, from seeds that lie far apart in a sample. All sources and
languages have cells of their own, null is `(none)`; the driver holds one number per cell and marginal, not rows. Null and empty texts have no tokens and are kept or dropped by their cell. A marginal category without tokens is left out
and its target goes to the others. Rows that repeat an id share its draw, as rows without an id do. Ties between topics go to the first.
An empty table gives an empty result. Whole texts of any length count. Other columns may have any name and are carried on.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import lean, materialise, small_batches
from .text import LOWER, NOT_SPACE, blocks, span_hashes, string_bytes, word_bounds

DIMS, TOPICS = 512, 8
NONE = "(none)"
log = logging.getLogger(__name__)
#: Cells up to which their table is broadcast; the result is the same beyond it.
BROADCAST_CELLS = 100_000


def word_counts(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word counts (texts x DIMS), square-rooted, and the number of words."""
    low = LOWER[raw]
    starts, ends, first = word_bounds(low, off, NOT_SPACE)
    h = span_hashes(low, starts, ends)
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    c = np.bincount(doc * DIMS + (h >> np.uint64(55)).astype(np.int64), minlength=n * DIMS).reshape(n, DIMS)
    return np.sqrt(c).astype(np.float32), np.diff(first)


def pack(counts: np.ndarray) -> list[bytes]:
    """Rows of square-rooted counts as bytes of the counts, one byte each where all are below 256, four otherwise."""
    whole = np.rint(counts.astype(np.float64) ** 2).astype(np.uint32)
    small, narrow = whole.max(1, initial=0) < 256, whole.astype(np.uint8)
    return [narrow[i].tobytes() if small[i] else whole[i].tobytes() for i in range(len(whole))]


def unpack(column: pa.Array) -> np.ndarray:
    """The rows of pack() as square-rooted counts."""
    rows = column.to_pylist()
    x = np.empty((len(rows), DIMS), np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r, np.uint8 if len(r) == DIMS else np.uint32)
    return np.sqrt(x)


def _vectors(text: int, names: list[str]):
    """Map over rows with a text column: the columns of names, number of words, and the packed word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = string_bytes(b.column(text))
            rows, tokens = [], [np.zeros(0, np.int64)]
            for i, j in blocks(off):
                x, n = word_counts(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                rows += pack(x)
                tokens.append(n.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in b.schema.names if c in names], pa.array(np.concatenate(tokens)), pa.array(rows, pa.binary())], [*names, "__tokens", "__x"])

    return run


def _units(x: np.ndarray) -> np.ndarray:
    x = x[x.any(1)]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: Sums of vectors are sums of integers, so that their order does not matter.
_ONE = 1 << 24


def _sums(centres: np.ndarray):
    """Map over packed word counts: for each topic the sum of the unit vectors nearest to its centroid, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(centres.shape, np.int64), np.zeros(len(centres), bool)
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                x = _units(unpack(b.column(0).slice(lo, 4096)))
                near = np.argmax(x @ centres.T, 1)
                x = np.rint(x * np.float32(_ONE)).astype(np.int64)
                for k in np.unique(near):
                    total[k] += x[near == k].sum(0)
                    seen[k] = True
        topic, at = np.repeat(np.flatnonzero(seen), DIMS).astype(np.int32), np.tile(np.arange(DIMS, dtype=np.int32), int(seen.sum()))
        yield pa.RecordBatch.from_arrays([pa.array(topic), pa.array(at), pa.array(total[seen].ravel())], ["topic", "at", "s"])

    return run


def seeds(vectors: DataFrame, topics: int = TOPICS, sample: int = 3000) -> np.ndarray:
    """Starting centroids (topics x DIMS): vectors far apart among those of the `sample` documents of least hash of their id."""
    ids = vectors.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = vectors.select("doc_id", "__x").join(F.broadcast(ids), "doc_id", "left_semi").orderBy("doc_id", F.xxhash64("__x")).limit(sample)
    x = _units(unpack(rows.select("__x").toArrow().column("__x")))
    if len(x) == 0:
        return np.zeros((1, DIMS), np.float32)
    centre = [x[0]]
    while len(centre) < min(topics, len(x)):  # farthest point first
        centre.append(x[int(np.argmin((x @ np.stack(centre).T).max(1)))])
    return np.stack(centre)


def fit_topics(vectors: DataFrame, topics: int = TOPICS, rounds: int = 15) -> np.ndarray:
    """Unit centroids (topics x DIMS) of spherical k-means over all rows (doc_id, __x)."""
    c = seeds(vectors, topics)
    if not c.any():
        return c
    for _ in range(rounds):
        t = vectors.select("__x").mapInArrow(lean(_sums(c)), "topic int, at int, s long").groupBy("topic", "at").agg(F.sum("s").alias("s")).toArrow()
        total = np.zeros(c.shape, np.float64)
        total[t.column("topic").to_numpy(), t.column("at").to_numpy()] = t.column("s").to_numpy()
        some = total.any(1)
        new = c.copy()
        new[some] = (total[some] / np.linalg.norm(total[some], axis=1, keepdims=True)).astype(np.float32)
        if (new == c).all():
            break
        c = new
    return c


def _topics(centres: np.ndarray):
    """Map over (doc_id, source, lang, __tokens, __x): the topic in place of the word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            topic = [np.zeros(0, np.int32), *(np.argmax(unpack(b.column(4).slice(lo, 4096)) @ centres.T, 1).astype(np.int32) for lo in range(0, b.num_rows, 4096))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.concatenate(topic)), b.column(3)], ["doc_id", "source", "lang", "__topic", "__tokens"])

    return run


def rake(cells: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Weights per cell: cells * weights has the target shares in each marginal. axes: each cell's category in each marginal."""
    w = np.ones(len(cells))
    total = cells.sum()
    for _ in range(rounds):
        worst = 0.0
        for at, share in zip(axes, targets, strict=True):
            have = np.bincount(at, cells * w, minlength=len(share)) / total
            want = np.where(have > 0, share, 0)
            want = want / want.sum() if want.sum() else have
            factor = np.divide(want, have, out=np.ones_like(have), where=have > 0)
            worst = max(worst, float(np.abs(factor[have > 0] - 1).max(initial=0)))
            w *= factor[at]
        if worst < tolerance:
            break
    return w


def calibrate(tokens: np.ndarray, w: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, c * w) whose expected tokens are the budget (or all tokens, if fewer)."""
    if tokens.sum() <= budget or not len(tokens):
        return np.where(w > 0, 1.0, 0.0)
    lo, hi = 0.0, 1.0
    while (tokens * np.minimum(1, hi * w)).sum() < budget and hi < 1e18:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (tokens * np.minimum(1, mid * w)).sum() < budget else (lo, mid)
    return np.minimum(1, hi * w)


def waterfill(most: np.ndarray, share: np.ndarray, budget: float) -> np.ndarray:
    """Tokens of each category: the budget in proportion to the shares, at most `most` of each, what exceeds it going to the others."""
    out, left = np.zeros(len(most)), np.where(share > 0, most, 0.0) > 0
    while left.any():
        give = (budget - out[~left].sum()) * np.where(left, share, 0) / share[left].sum()
        over = left & (give >= most)
        if not over.any():
            return np.where(left, give, out)
        out[over] = most[over]
        left &= ~over
    return out


def bounded(tokens: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], budget: float, rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Probabilities min(1, w), w raked, so that the expected tokens have the target shares of the budget in each marginal where that can be met."""
    budget = min(budget, tokens.sum())
    w = np.full(len(tokens), budget / tokens.sum())
    goals = [waterfill(np.bincount(at, tokens, minlength=len(share)), share, budget) for at, share in zip(axes, targets, strict=True)]
    for _ in range(rounds):
        before = np.minimum(1, w)
        for at, goal in zip(axes, goals, strict=True):
            n = len(goal)
            f = np.zeros(n)
            for _ in range(100):  # Newton from below on a concave, piecewise linear function: exact after some steps
                at_most = (w * f[at] >= 1) & (w > 0)
                fixed, free = np.bincount(at, tokens * at_most, minlength=n), np.bincount(at, np.where(at_most, 0, tokens * w), minlength=n)
                new = np.maximum(f, np.divide(goal - fixed, free, out=f.copy(), where=free > 0))
                done = (new <= f * (1 + 1e-15)).all()
                f = new
                if done:
                    break
            w = w * f[at]
            # beyond the bound by a large factor says no more than the bound itself
            w = np.minimum(w, 1e12)
        if np.abs(np.minimum(1, w) - before).max(initial=0) < tolerance:
            break
    return calibrate(tokens, w, budget)


def _describe(centres: np.ndarray):
    """Map over (row, a struct with a text; source; lang; draw): the same, topic and number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = string_bytes(pc.struct_field(b.column(0), "text"))
            topic, tokens = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for i, j in blocks(off):
                x, n = word_counts(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                topic.append(np.argmax(x @ centres.T, 1).astype(np.int32))
                tokens.append(n.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(topic)), pa.array(np.concatenate(tokens))], [*b.schema.names, "__topic", "__tokens"])

    return run


def _named(column: str):
    """The column as text with null as NONE."""
    return F.coalesce(F.col(column).cast("string"), F.lit(NONE))


def flattened(shares: dict, power: float) -> dict:
    """Target shares proportional to the present ones to a power: 1 leaves them, 0 makes them equal."""
    p = {k: v**power for k, v in shares.items() if v > 0}
    return {k: v / sum(p.values()) for k, v in p.items()} if p else {}


class Mix:
    """A fitted mix: topic centroids, the marginal categories as columns, and weight and probability of each cell."""

    def __init__(self, docs: DataFrame, share: float = 0.5, power: float = 0.5, targets: dict[str, dict] | None = None, topics: int = TOPICS, seed: int = 1):
        """share: the expected part of all tokens in the sample. targets: shares by category for source, lang and topic; a marginal that is
        not given gets its present shares flattened by `power`."""
        self.seed = seed
        narrow = small_batches(docs).select("doc_id", "source", "lang", "text")
        three = [narrow.schema[c] for c in ("doc_id", "source", "lang")]
        held = T.StructType([*three]).add("__tokens", T.LongType()).add("__x", T.BinaryType())
        vectors = materialise(narrow.mapInArrow(lean(_vectors(3, ["doc_id", "source", "lang"])), held), "mix-vectors")
        self.centres = fit_topics(vectors, topics)
        fields = T.StructType([*three]).add("__topic", T.IntegerType()).add("__tokens", T.LongType())
        self.rows = materialise(vectors.mapInArrow(lean(_topics(self.centres)), fields), "mix-described")
        self.source, self.lang = _named("source"), _named("lang")
        cells = self.rows.groupBy(self.source.alias("s"), self.lang.alias("l"), "__topic").agg(F.sum("__tokens").alias("t")).orderBy("s", "l", "__topic").toArrow().combine_chunks()
        tokens = cells.column("t").to_numpy().astype(np.float64)
        names, axes, wanted = [], [], []
        for name, column in (("source", "s"), ("lang", "l"), ("topic", "__topic")):
            coded = cells.column(column).combine_chunks().dictionary_encode()
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            values, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            have = np.bincount(at, tokens, minlength=len(values)) / max(tokens.sum(), 1)
            goal = (targets or {}).get(name) or flattened(dict(zip(values, have, strict=True)), power)
            names.append(values)
            axes.append(at)
            wanted.append(np.array([goal.get(v, 0.0) for v in values]))
        w = rake(tokens, axes, wanted) if len(tokens) and tokens.sum() else np.ones(len(tokens))
        budget = share * float(tokens.sum())
        p = bounded(tokens, axes, wanted, budget) if len(tokens) and tokens.sum() else np.ones(len(tokens))
        #: per marginal and category: the target share, and that of the expected sample
        self.shares: dict[str, dict] = {}
        for name, values, at, goal in zip(("source", "lang", "topic"), names, axes, wanted, strict=True):
            got = np.bincount(at, tokens * p, minlength=len(values))
            got, goal = got / max(got.sum(), 1e-300), goal / max(goal.sum(), 1e-300)
            self.shares[name] = {v: (float(x), float(y)) for v, x, y in zip(values, goal, got, strict=True)}
            if len(got) and np.abs(got - goal).max() > 1e-3:
                worst = int(np.argmax(np.abs(got - goal)))
                log.warning("mix: %s shares cannot all be met; %s has %.4f, not %.4f", name, values[worst], got[worst], goal[worst])
        self.cells = len(tokens)
        table = pa.table([*(cells.column(c) for c in ("s", "l", "__topic")), pa.array(w, pa.float64()), pa.array(p, pa.float64())], ["__s", "__l", "__topic", "__weight", "__probability"])
        self.table = docs.sparkSession.createDataFrame(table, "__s string, __l string, __topic int, __weight double, __probability double")

    def drawn(self, rows: DataFrame) -> DataFrame:
        """Rows with doc_id, source, lang and __topic, and what their cell and the hash of their id say."""
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), "doc_id"), 11).cast("double") / float(1 << 53)
        table = F.broadcast(self.table) if self.cells <= BROADCAST_CELLS else self.table
        joined = rows.withColumns({"__s": self.source, "__l": self.lang}).join(table, ["__s", "__l", "__topic"])
        return joined.withColumn("__sampled", draw < F.col("__probability")).drop("__s", "__l")

    def sample(self, docs: DataFrame) -> DataFrame:
        """The sampled documents with all their columns. No text is shuffled: topics are found again in a map over the documents."""
        # the documents travel as one struct, so that none of their columns clashes with ours
        rows = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "source", "lang")
        rows = rows.mapInArrow(lean(_describe(self.centres)), T.StructType([*rows.schema.fields]).add("__topic", T.IntegerType()).add("__tokens", T.LongType()))
        return self.drawn(rows).filter("__sampled").select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, weight, probability, sampled. Options as those of Mix."""
    mix = Mix(docs, **options)
    names = {"__topic": "topic", "__tokens": "n_tokens", "__weight": "weight", "__probability": "probability", "__sampled": "sampled"}
    return mix.drawn(mix.rows).select("doc_id", "source", "lang", *[F.col(k).alias(v) for k, v in names.items()])
