"""Language identification by mixtures: EM over byte-trigram likelihoods, languages chosen by penalised likelihood.

Training counts byte trigrams of lower-cased words per language, keeps the `features` trigrams that tell most about
the language, and smooths their distributions (all others share one further outcome). A document's
trigram counts are a mixture of these distributions: expectation-maximisation gives its proportions. Starting from the one
best language, languages are added by proportion as long as the Bayesian information criterion falls; the text's
language is the one of largest proportion in the selected set, and the score is that proportion.

Null texts, empty texts and texts without a letter are `und` with score 0. Rows with null text or language are no
training data. Without any training row all texts are `und`. Ties go to the language first in alphabetical order.
Training takes a sample of the labelled rows of each language: those whose hashed id is under per_language / (their number), about `per_language`
documents; rows that repeat an id are in it together, rows without an id are not. It knows the `languages` most frequent ones. Whole texts of any
length count. An empty table gives an empty result. Other columns may have any name and are carried on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .store import lean, small_batches
from .text import LOWER, blocks, string_bytes

UND = "und"
_CLASS = LOWER.copy()
for _b in range(128):
    if not (65 <= _b <= 90 or 97 <= _b <= 122):
        _CLASS[_b] = 32
ROUNDS = 12
#: Bytes whose trigrams are counted at once.
PIECE = 1 << 20


def trigrams(raw: np.ndarray) -> np.ndarray:
    """24-bit codes of the trigrams that begin at each byte but the last two; non-letters of ASCII count as spaces."""
    x = _CLASS[raw].astype(np.int32)
    return (x[:-2] << 16) | (x[1:-1] << 8) | x[2:] if len(x) > 2 else np.zeros(0, np.int32)


def has_letter(text: str) -> bool:
    return text.isascii() and any("a" <= c <= "z" for c in text.lower()) or any(c.isalpha() for c in text)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over (lang, text): trigram counts per language and batch."""
    for b in batches:
        raw, off = string_bytes(b.column(1))
        parts: dict[str, list[np.ndarray]] = {}
        for i, lang in enumerate(b.column(0).to_pylist()):
            parts.setdefault(lang, []).append(trigrams(raw[off[i] : off[i + 1]]))
        for lang, found in parts.items():
            grams, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class LanguageModel:
    """Languages in alphabetical order, the feature of each trigram (0: any other), and log probabilities."""

    def __init__(self, langs: list[str], grams: np.ndarray, prob: np.ndarray):
        self.langs, self.grams, self.prob = langs, grams, prob
        self._table = None

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Features in two small levels: where the row of a trigram's first two bytes begins (0: in no feature), and in that row the feature by the third."""
        if self._table is None:
            heads, row = np.unique(self.grams >> 8, return_inverse=True)
            rows, cells = np.zeros(1 << 16, np.int32), np.zeros((len(heads) + 1) << 8, np.int32)
            rows[heads] = np.arange(1, len(heads) + 1) << 8
            cells[((row + 1) << 8) | (self.grams & 255)] = np.arange(1, len(self.grams) + 1)
            self._table = rows, cells
        return self._table

    def __getstate__(self):
        return {"langs": self.langs, "grams": self.grams, "prob": self.prob, "_table": None}

    def counts(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Feature counts of each text, PIECE bytes at a time."""
        n, width = len(off) - 1, len(self.grams) + 1
        out = np.zeros(n * width, np.float32)
        rows, cells = self.table
        for lo in range(0, len(raw) - 2, PIECE):
            g = trigrams(raw[lo : lo + PIECE + 2])
            doc = np.repeat(np.arange(n), np.diff(np.clip(off, lo, lo + len(g))))
            inside = np.ones(len(g), bool)  # trigrams that end in the text they begin in
            for o in off[1:-1][(off[1:-1] > lo) & (off[1:-1] < lo + len(g) + 2)]:
                inside[max(0, o - 2 - lo) : o - lo] = False
            out += np.bincount((doc * width + cells[rows[g >> 8] | (g & 255)])[inside], minlength=n * width)
        return out.reshape(n, width)

    def _em(self, c: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log likelihood of each row over the languages in use (rows x languages, boolean)."""
        pi = use / use.sum(1, keepdims=True)
        n = np.maximum(c.sum(1, keepdims=True), 1)
        for _ in range(ROUNDS):
            mixed = pi @ self.prob
            pi = pi * ((c / mixed) @ self.prob.T) / n
            pi = np.where(use, np.maximum(pi, 1e-12), 0)
            pi /= pi.sum(1, keepdims=True)
        return pi, (c * np.log(pi @ self.prob)).sum(1)

    def predict(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language index and proportion of each row of counts."""
        full, _ = self._em(c, np.ones((len(c), len(self.langs)), bool))
        order = np.argsort(-full, axis=1, kind="stable")
        n = np.maximum(c.sum(1), 2)
        single = c @ np.log(self.prob).T
        # the best single language first, then all others by proportion
        first = np.argmax(single, 1)[:, None]
        order = np.concatenate([first, order[order != first].reshape(len(c), -1)], 1)
        best_pi = np.zeros_like(full)
        best_pi[np.arange(len(c)), order[:, 0]] = 1
        best = -2 * single[np.arange(len(c)), order[:, 0]]
        live = np.arange(len(c))
        for size in range(2, len(self.langs) + 1):
            use = np.zeros((len(live), len(self.langs)), bool)
            for k in range(size):
                use[np.arange(len(live)), order[live, k]] = True
            use |= best_pi[live] > 0
            pi, ll = self._em(c[live], use)
            bic = -2 * ll + (size - 1) * np.log(n[live])
            better = bic < best[live]
            best_pi[live[better]], best[live[better]] = pi[better], bic[better]
            live = live[better]
            if not len(live):
                break
        top = np.argmax(best_pi, 1)
        return top, best_pi[np.arange(len(c)), top]


def train(docs: DataFrame, per_language: int = 2000, features: int = 2000, languages: int = 256) -> LanguageModel:
    """Fit on rows (doc_id, text, lang), for the `languages` most frequent; the driver gets at most 2^24 counts a language, in sums made by Spark."""
    rows = small_batches(docs).select("doc_id", "text", "lang").filter("text is not null and lang is not null and doc_id is not null")
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    part = common.select("lang", (F.lit(float(per_language)) / F.col("count")).alias("__part"))
    # at most `languages` rows: a proven bound for the broadcast
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / float(1 << 53)
    sample = rows.join(F.broadcast(part), "lang").filter(draw < F.col("__part"))
    sums = sample.select("lang", "text").mapInArrow(lean(_count), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    t = sums.toArrow()
    langs = sorted(set(t.column("lang").to_pylist()))
    if not langs:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 1)))
    at = np.searchsorted(langs, np.array(t.column("lang").to_pylist(), dtype=object).astype(str))
    grams, inverse = np.unique(t.column("gram").to_numpy(), return_inverse=True)
    counts = np.zeros((len(langs), len(grams)))
    counts[at, inverse] = t.column("n").to_numpy()
    p = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    mean = p.mean(0)
    telling = (p * np.log(p / mean)).sum(0)
    keep = np.sort(np.argsort(-telling, kind="stable")[:features])
    prob = np.concatenate([1 - p[:, keep].sum(1, keepdims=True), p[:, keep]], 1)
    prob = np.maximum(prob, 1e-9)
    return LanguageModel(langs, grams[keep].astype(np.int64), (prob / prob.sum(1, keepdims=True)).astype(np.float64))


def identify(docs: DataFrame, model: LanguageModel, pred_name: str = "lang_pred", score_name: str = "lang_score") -> DataFrame:
    """The documents with two more columns, by default lang_pred and lang_score (all else as it was, but for columns of these names, which are replaced)."""
    docs = docs.drop(pred_name, score_name)
    held = small_batches(docs).sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            column = b.column(b.schema.names.index("text"))
            raw, off = string_bytes(column)
            pred, score = [], []
            for i, j in blocks(off):
                part = column.slice(i, j - i).to_pylist()
                if m.langs:
                    top, p = m.predict(m.counts(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
                for k, text in enumerate(part):
                    known = bool(m.langs) and text is not None and has_letter(text)
                    pred.append(m.langs[top[k]] if known else UND)
                    score.append(min(1.0, float(p[k])) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*columns, pred_name, score_name])

    schema = StructType([*docs.schema.fields]).add(pred_name, StringType()).add(score_name, DoubleType())
    return docs.mapInArrow(lean(run), schema)
