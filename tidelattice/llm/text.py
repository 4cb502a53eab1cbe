"""Whole texts as byte arrays: words, their hashes and shingles, computed by numpy over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
#: Bytes and texts of one block; a longer text is a block by itself.
BLOCK, BLOCK_ROWS = 1 << 20, 512

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, MASK, 256, dtype=np.uint64, endpoint=True)
_BYTE2 = np.random.default_rng(20240301).integers(0, MASK, 256, dtype=np.uint64, endpoint=True)
_MIX = _rng.integers(0, MASK, 64, dtype=np.uint64, endpoint=True) | np.uint64(1)
_R = 0x9E3779B97F4A7C15
_RI = pow(_R, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Word bytes of `[^\x20\x09-\x0D]+`, and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
NOT_SPACE = ~SPACES
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, base in ((0, _R), (1, _RI)):
            with np.errstate(over="ignore"):
                _pow[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))])
    return _pow[0][:n], _pow[1][:n]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, most: int = BLOCK, rows: int = BLOCK_ROWS) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of at most `rows` texts with at most `most` bytes together, or one longer text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, i + rows, n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes inside each text, and the first word index of each text."""
    if len(raw) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = table[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = w[:-1]
    before &= ~edge[:-1]
    starts = np.flatnonzero(w & ~before)
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = w[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans, the same for equal bytes anywhere; `second` gives others, by other values of the bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    p, q = _powers(len(raw) + 1)
    c = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_BYTE2 if second else _BYTE)[raw] * p[:-1], out=c[1:])
    return mix((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles (of its whole sequence if shorter), and the first index of each text."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    size = np.repeat(np.minimum(n, k), count)
    out = size.astype(np.uint64) * _MIX[-1]
    for j in range(k):
        live = size > j
        if live.all():
            out += h[start + j] * _MIX[j]
        else:
            out[live] += h[start[live] + j] * _MIX[j]
    return mix(out), at


def fresh(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as it takes to differ from all columns (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_bucket(doc_id, n: int):
    """crc32 of the id as text, modulo n, as a column."""
    from pyspark.sql import functions as F

    return F.crc32(doc_id.cast("string").cast("binary")) % n
