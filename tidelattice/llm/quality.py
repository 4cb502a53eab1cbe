"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is described by hashed counts: trigrams of character classes, words, and how often a word repeats the one before it.
A bounded sample of labelled texts gives document frequencies and, by a truncated singular value decomposition of the weighted counts, a
latent space; the sample's unit vectors are broadcast (REFERENCES x DIMS floats at most). Every document's
vector is compared with all of them in blocks of exact cosine products, and its score is the mean label of its nearest neighbours,
weighted by similarity and by the inverse frequency of their class.

Empty and null texts have the zero vector and get the score of an uninformed vote (0.5), as do all texts if
there are no labels. Several labels of one document are each a reference. Ties go to the earlier reference. Whole texts of any length are
described. Repeated rows get a score each, an empty table an empty result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import lean, small_batches
from .text import LOWER, NOT_SPACE, blocks, span_hashes, string_bytes, word_bounds

SHAPES, WORDS, EXTRA = 2048, 1024, 4
WIDTH = SHAPES + WORDS + EXTRA
#: The sample's size, the latent dimensions, the neighbours that vote, and the power of similarity in a vote.
REFERENCES, DIMS, NEIGHBOURS, POWER = 4096, 64, 15, 4

_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    if 97 <= _b <= 122:
        _CLASS[_b] = 1
    elif 65 <= _b <= 90:
        _CLASS[_b] = 2
    elif 48 <= _b <= 57:
        _CLASS[_b] = 3
    elif _b >= 128:
        _CLASS[_b] = 4
    elif _b in (9, 11, 12, 13, 32):
        _CLASS[_b] = 5
    elif _b == 10:
        _CLASS[_b] = 6
    elif _b > 32:
        _CLASS[_b] = 7 + _b
_SHAPE3 = np.random.default_rng(3).integers(1, 1 << 62, 3)


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Log counts of each text (texts x WIDTH)."""
    n = len(off) - 1
    out = np.zeros((n, WIDTH), np.float32)
    if len(raw) == 0:
        return out
    doc = np.repeat(np.arange(n), np.diff(off))
    if len(raw) > 2:
        c = _CLASS[raw]
        with np.errstate(over="ignore"):
            code = ((c[:-2] * _SHAPE3[0] + c[1:-1] * _SHAPE3[1] + c[2:] * _SHAPE3[2]) >> 40) & (SHAPES - 1)
        ok = doc[:-2] == doc[2:]
        out[:, :SHAPES] = np.bincount((doc[:-2] * SHAPES + code)[ok], minlength=n * SHAPES).reshape(n, SHAPES)
    low = LOWER[raw]
    starts, ends, first = word_bounds(low, off, NOT_SPACE)
    h = span_hashes(low, starts, ends)
    wdoc = np.repeat(np.arange(n), np.diff(first))
    out[:, SHAPES : SHAPES + WORDS] = np.bincount(wdoc * WORDS + (h >> np.uint64(54)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    words = np.maximum(np.diff(first), 1)
    if len(h) > 1:
        again = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
        out[:, SHAPES + WORDS] = np.bincount(wdoc[1:][again], minlength=n)
    # relative to the text's length, so that long and short texts of one kind are alike
    out[:, :SHAPES] /= np.maximum(np.diff(off), 1)[:, None] / 1000
    out[:, SHAPES:] /= words[:, None] / 200
    return np.log1p(out)


class NeighbourModel:
    """Weights and axes of the latent space, unit reference vectors, their labels and vote weights."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, refs: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        self.idf, self.axes, self.refs, self.labels, self.weights = idf, axes, refs, labels, weights

    def embed(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.refs) == 0:
            return np.full(len(x), 0.5)
        v = self.embed(x)
        empty = ~x.any(1)
        k = min(NEIGHBOURS, len(self.refs))
        out = np.empty(len(x))
        for i in range(0, len(x), 256):
            sim = v[i : i + 256] @ self.refs.T
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(sim, near, 1), 1e-6) ** POWER * self.weights[near]
            out[i : i + 256] = (w * self.labels[near]).sum(1) / w.sum(1)
        out[empty] = 0.5
        return np.clip(out, 0.0, 1.0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, off = string_bytes(b.column(1))
        rows = [features(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in blocks(off)]
        x = np.concatenate(rows) if rows else np.zeros((0, WIDTH), np.float32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary()), b.column(2)], ["label", "x", "h"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", references: int = REFERENCES) -> NeighbourModel:
    """Fit on at most `references` labelled documents: those of least hash of their id, half of them of either class as far as there are so many."""
    named = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    chosen = None
    for value in (0, 1):
        own = named.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(references // 2)
        chosen = own if chosen is None else chosen.unionByName(own)
    # at most `references` rows of two numbers: a proven bound for the broadcast
    sample = small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text", F.xxhash64("doc_id").alias("h"))
    # described first, so that rows of WIDTH numbers are sorted, and no texts
    t = sample.mapInArrow(lean(_features), "label int, x binary, h long").orderBy("h", F.xxhash64("x"), "label").limit(references).toArrow()
    y = t.column("label").to_numpy().astype(np.float64)
    if len(y) == 0:
        z = np.zeros((0, DIMS), np.float32)
        return NeighbourModel(np.ones(WIDTH, np.float32), np.zeros((WIDTH, DIMS), np.float32), z, y, y)
    x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float16).reshape(len(y), WIDTH).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.1
    a = x * idf
    # randomised range finder with power steps, then an exact decomposition in the small space
    dims = min(DIMS, *a.shape)
    q = np.linalg.qr(a.T @ np.random.default_rng(11).standard_normal((len(a), dims + 16)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(a.T @ (a @ q))[0]
    _, _, vt = np.linalg.svd(a @ q, full_matrices=False)
    axes = np.ascontiguousarray(q @ vt[:dims].T, np.float32)
    model = NeighbourModel(idf, axes, np.zeros((0, dims), np.float32), y, y)
    model.refs = model.embed(x).astype(np.float32)
    share = np.where(y == 1, y.mean(), 1 - y.mean())
    model.weights = 0.5 / np.maximum(share, 1e-9)
    return model


def classify(docs: DataFrame, model: NeighbourModel) -> DataFrame:
    """One row per document: doc_id and score."""
    held = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = string_bytes(b.column(1))
            got = [held.value.score(features(raw[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in blocks(off)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(got) if got else np.zeros(0))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
