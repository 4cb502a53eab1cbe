"""Substring duplicates by hashing normalised units: lines, the sentences of a line, and pieces of long sentences.

A unit is normalised to its lower-cased words (letters, digits, non-ASCII) and digested to 128 bits, two hashes from independent
hashes of its words. Lines, which end at a line feed, are the method's units: a line of at least `line` words goes if its digest has occurred. So that
a passage inside longer lines is found too, lines are cut (unless `pieces` is false) after sentences, and sentences of more than
LONG words after the words of least hash of all windows of CUT words, so that a passage is cut alike wherever it stands, and
cuts are at most CUT words apart. A piece of fewer than
`least` words is digested with the words before it, `least` in all, so that a short phrase alone is never taken for a
repeat; at the start of a text, where there are too few, it stays. Digests are grouped globally; the
occurrence in the smallest doc_id, and there the first, is kept, and all others are removed with their original
offsets retained (code points, end exclusive; white space that follows a removed unit goes with it).

By default shorter lines than 20 words stay, as greetings, headings and licences recur in documents that repeat nothing else; line=1 removes every repeated line.

Null texts give null clean texts and empty texts empty ones, without units. Rows that repeat a doc_id count as one document. Rows with null doc_id lose only what
repeats inside them. Texts of any length are read whole. An empty table gives an empty result. Only doc_id (of an integer type) and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .membership import split
from .store import join_by_size, lean, materialise, small_batches
from .text import ALNUM, LOWER, SPACES, _powers, blocks, mix, span_hashes, string_bytes, word_bounds

#: Words that a digest covers at least, of a sentence that is not cut, and of the windows of a longer one.
LEAST, LONG, CUT = 20, 24, 16
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def units(raw: np.ndarray, off: np.ndarray, least: int = LEAST, line: int | None = None, pieces: bool = True) -> tuple[np.ndarray, ...]:
    """Units of a block of texts: text index, first and past-the-end byte, two 64-bit digests, and whether eligible; then the number of
    their line, the line's two digests, and whether the line is digested by itself."""
    shortest = least if line is None else line
    n = len(raw)
    z = np.zeros(0, np.int64)
    if n == 0:
        return z, z, z, z, z, z.astype(bool), z, z, z, z.astype(bool)
    space = SPACES[raw]
    begin = np.zeros(n, bool)
    begin[off[:-1][np.diff(off) > 0]] = True
    after = np.zeros(n, bool)  # a line or sentence has ended before this byte
    after[1:] = raw[:-1] == 10
    ended = np.zeros(n, bool)
    if pieces:
        ended[2:] = _STOP[raw[:-2]] & space[1:-1]
    begin |= after | (ended & ~space)
    starts = np.flatnonzero(begin)
    doc = np.searchsorted(off, starts, side="right") - 1
    ends = np.concatenate([starts[1:], [n]])
    low = LOWER[raw]
    ws, we, first = word_bounds(low, off, ALNUM)
    h, h2 = span_hashes(low, ws, we), span_hashes(low, ws, we, second=True)
    a = np.searchsorted(ws, starts)
    b = np.searchsorted(ws, ends)
    long = np.flatnonzero(b - a > LONG) if pieces else z
    if len(long):
        inside = np.zeros(len(h) + 1, np.int8)
        np.add.at(inside, a[long] + least, 1)  # the first piece is long enough to count alone
        np.add.at(inside, b[long], -1)
        window = np.zeros(len(h) + 1, np.int8)  # first words of windows inside one long sentence
        np.add.at(window, a[long], 1)
        np.add.at(window, b[long] - CUT + 1, -1)
        at = np.flatnonzero(np.cumsum(window[:-1]) > 0)
        after_word = np.zeros(len(h) + 1, bool)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            after_word[part + np.argmin(h[part[:, None] + np.arange(CUT)], 1) + 1] = True
        cuts = ws[np.flatnonzero((np.cumsum(inside[:-1]) > 0) & after_word[:-1])]
        starts = np.union1d(starts, cuts)
        doc = np.searchsorted(off, starts, side="right") - 1
        ends = np.concatenate([starts[1:], [n]])
        a, b = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    size = b - a
    wide = np.where(size >= least, a, b - least)
    ok = (size > 0) & (wide >= first[doc]) & pieces
    wide = np.where(ok, wide, a)
    # lines: runs of units up to the next line feed or text
    head = after[starts].copy()
    head[0] = True
    head[1:] |= doc[1:] != doc[:-1]
    first_unit = np.flatnonzero(head)
    at_line = np.cumsum(head) - 1
    la, lb = a[first_unit], b[np.concatenate([first_unit[1:], [len(starts)]]) - 1]
    # a line whose units are all eligible and need no words before it is repeated just when they are
    single = (lb > la) & (lb - la >= shortest) & np.logical_or.reduceat((size > 0) & ~(ok & (size >= least)), first_unit)
    p, q = _powers(len(h) + 1)
    out, whole = [], []
    for x in (h, h2):
        c = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * p[:-1], out=c[1:])
        out.append(mix((c[b] - c[wide]) * q[wide] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
        whole.append(mix(((c[lb] - c[la]) * q[la] + (lb - la).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xA0761D6478BD642F)).view(np.int64))
    return doc, starts, ends, out[0], out[1], ok, at_line, whole[0][at_line], whole[1][at_line], single[at_line]


def _emit(how: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = string_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in blocks(off):
                doc, _, _, h1, h2, ok, line, l1, l2, single = units(raw[off[i] : off[j]], off[i : j + 1] - off[i], *how)
                one = single & np.concatenate([[True], line[1:] != line[:-1]])[: len(line)]
                rows = np.stack([np.concatenate([x[ok], y[one]]) for x, y in ((doc, doc), (h1, l1), (h2, l2))], 1)
                rows = np.unique(rows, axis=0) if len(rows) else np.zeros((0, 3), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array(ids[i + rows[:, 0]].astype(np.int64))], ["h1", "h2", "doc_id"])

    return run


def _remove(how: tuple, names: list[str]):
    """Map over (text, drop, ...): the other columns, with counts, spans and the clean text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = string_bytes(batch.column(0))
            texts = batch.column(0).to_pylist()
            drops = batch.column(1).to_pylist()
            n_units = np.zeros(batch.num_rows, np.int64)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, j in blocks(off):
                own, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                doc, starts, ends, h1, h2, ok, line, l1, l2, single = units(own, at, *how)
                n_units[i:j] = np.bincount(doc, minlength=j - i)
                points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                for d in range(j - i):
                    a, b = edge[d], edge[d + 1]
                    if a == b:
                        continue
                    gone = {(x["h1"], x["h2"]) for x in drops[i + d] or ()}
                    keys = list(zip(h1[a:b].tolist(), h2[a:b].tolist(), strict=True))
                    lines = list(zip(l1[a:b].tolist(), l2[a:b].tolist(), strict=True))
                    n_lines = line[b - 1] - line[a] + 1
                    if not gone and len(set(keys)) == len(keys) and len(set(lines)) == n_lines:
                        continue
                    keep, removed = [], spans[i + d]
                    base = points[at[d]]
                    line_gone = False
                    for u in range(a, b):
                        key = keys[u - a]
                        if u == a or line[u] != line[u - 1]:
                            line_gone = bool(single[u]) and lines[u - a] in gone
                            if single[u]:
                                gone.add(lines[u - a])
                        if line_gone or (ok[u] and key in gone):
                            s, e = int(points[starts[u]] - base), int(points[ends[u]] - base)
                            if removed and removed[-1]["end"] == s:
                                removed[-1]["end"] = e
                            else:
                                removed.append({"start": s, "end": e})
                        else:
                            keep.append(own[starts[u] : ends[u]])
                            if ok[u]:
                                gone.add(key)
                    if removed:
                        texts[i + d] = b"".join(x.tobytes() for x in keep).decode("utf-8", "surrogatepass")
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(n_units), pa.array(spans, span), pa.array(texts, pa.string())], [*names, "n_units", "removed", "clean_text"])

    return run


def dedup_units(docs: DataFrame, least: int = LEAST, line: int | None = None, pieces: bool = True) -> DataFrame:
    """One row per document: doc_id, n_units, removed (array of start, end), clean_text. line: words of the shortest line that goes (least, if
    not given). pieces: whether passages inside lines go too."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be of an integer type")
    how = (least, line, pieces)
    rows = small_batches(docs).select("doc_id", "text")
    found = materialise(rows.filter("doc_id is not null and text is not null").mapInArrow(lean(_emit(how)), "h1 long, h2 long, doc_id long"), "units")
    repeated = materialise(found.groupBy("h1", "h2").agg(F.min("doc_id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1"), "units-repeated")
    # only digests that may be repeated, and then only texts that may lose something, are shuffled
    maybe, _ = split(found, "h1", repeated.select("h1").distinct())
    later = join_by_size(maybe, repeated, ["h1", "h2"], "__n", found.count()).filter("__first != doc_id")
    drop = materialise(later.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("__drop")), "units-drop")
    loses, rest = split(rows, "doc_id", drop.select("doc_id"))
    ready = loses.join(drop, "doc_id", "left").select("text", "__drop", "doc_id").unionByName(rest.select("text", F.lit(None).cast(drop.schema["__drop"].dataType).alias("__drop"), "doc_id"))
    schema = T.StructType([docs.schema["doc_id"]]).add("n_units", T.LongType()).add("removed", T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType()))).add("clean_text", T.StringType())
    return ready.mapInArrow(lean(_remove(how, ["doc_id"])), schema)
