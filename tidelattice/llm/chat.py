"""Chat formatting by columnar byte assembly.

A turn becomes <|im_start|>role\\n + text + <|im_end|>\\n. Inside roles and texts a backslash is doubled and "<|" becomes "<\\|", so no
control string can come from data, and unescape() gives back every text exactly. Rows are put in order by range
partitioning on (conv_id, turn), which splits a conversation of any size; each task computes segment lengths,
cumulative offsets and scatter indices in numpy, and copies headers and contents into one preallocated Arrow buffer.
The output is one row per conversation and piece (a conversation has several pieces only where a task or batch ends inside it),
with the loss mask as byte ranges of the assistant's texts.

Null roles and texts count as empty. Turns with equal numbers are ordered by role and text, null turns first. Repeated rows are repeated turns.
Conversations with null id form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import lean, small_batches
from .text import string_bytes

START, END = "<|im_start|>", "<|im_end|>\n"
#: Bytes assembled in one buffer.
BUFFER = 8 << 20
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(column: pa.Array) -> pa.Array:
    """No "<|" remains, and each backslash is followed by a backslash, `|` or `n`."""
    return pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def assemble(segments: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise concatenation of byte columns (bytes, offsets): the bytes, and each segment's start (rows x segments + 1 past the end)."""
    lengths = np.stack([np.diff(off) for _, off in segments], 1)
    ends = np.cumsum(lengths.ravel())
    total = int(ends[-1]) if len(ends) else 0
    starts = (ends - lengths.ravel()).reshape(lengths.shape)
    out = np.empty(total, np.uint8)
    for k, (raw, off) in enumerate(segments):
        if len(raw):
            at = np.repeat(starts[:, k] - off[:-1], lengths[:, k]) + np.arange(len(raw))
            out[at] = raw
    return out, starts


def _constant(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.tile(raw, n), np.arange(n + 1, dtype=np.int64) * len(raw)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over ordered (conv_id, role, text): pieces (conv_id, piece, formatted, loss_starts, loss_ends)."""
    from pyspark import TaskContext

    piece = TaskContext.get().partitionId() << 33
    for b in batches:
        role = b.column(1).fill_null("")
        text = b.column(2).fill_null("")
        _, off = string_bytes(text)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BUFFER, side="right")) - 1)
            hi = min(hi, b.num_rows)
            n = hi - lo
            roles = pc.replace_substring(escape(role.slice(lo, n)), "\n", "\\n")
            raw, starts = assemble([_constant(START, n), string_bytes(roles), _constant("\n", n), string_bytes(escape(text.slice(lo, n))), _constant(END, n)])
            ids = b.column(0).slice(lo, n)
            known = ids.fill_null(0).to_numpy()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.flatnonzero((known[1:] != known[:-1]) | (null[1:] != null[:-1])) + 1])
            cut = np.concatenate([starts[first, 0], [len(raw)]])
            last = np.concatenate([first[1:], [n]])
            loss = pc.equal(role.slice(lo, n), "assistant").to_numpy(zero_copy_only=False)
            a, z = [], []
            for i, j, base in zip(first, last, cut[:-1], strict=True):
                own = np.flatnonzero(loss[i:j]) + i
                a.append((starts[own, 3] - base).tolist())
                z.append((starts[own, 4] - base).tolist())
            formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(raw))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(piece + np.arange(len(first))), formatted, pa.array(a, longs), pa.array(z, longs)], ["conv_id", "piece", "formatted", "loss_starts", "loss_ends"])
            piece += len(first)
            lo = hi


def format_chats(conversations: DataFrame) -> DataFrame:
    """Pieces of formatted conversations: conv_id, piece (in order), formatted, loss_starts, loss_ends (bytes of the piece)."""
    n = max(8, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = small_batches(conversations).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ordered = rows.repartitionByRange(n, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(lean(_format), "conv_id long, piece long, formatted string, loss_starts array<long>, loss_ends array<long>")


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a piece."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        role_end = formatted.index("\n", at)
        end = formatted.index(END, role_end)
        yield unescape(formatted[at + len(START) : role_end]), unescape(formatted[role_end + 1 : end])
        at = end + len(END)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over ordered pieces: one row per conversation. Only hash states are held from piece to piece."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state, done = None, []

    def close() -> None:
        if state:
            done.append((state["id"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"]))

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kinds[k]) for k in range(6)], names)
        done.clear()
        return rows

    for b in batches:
        for conv, formatted, a, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if state is None or state["id"] != conv:
                close()
                state = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0}
            for role, text in parse(formatted):
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state["n"] += 1
            raw = formatted.encode("utf-8", "surrogatepass")
            for x, y in zip(a, z, strict=True):
                text = unescape(raw[x:y].decode("utf-8", "surrogatepass"))
                state["chars"] += len(text)
                state["loss"].update(text.encode("utf-8", "surrogatepass"))
            state["all"] += len(formatted)
        yield flush()
    close()
    yield flush()


def digests(pieces: DataFrame) -> DataFrame:
    """What the output says when read back: turns and loss texts per conversation, as counts and hashes."""
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "formatted", "loss_starts", "loss_ends")
    return ordered.mapInArrow(lean(_digest), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
