r"""Chat formatting by columnar byte assembly.

A turn becomes `<|im_start|>role\ntext<|im_end|>\n`. Inside texts and roles every `<`, backslashes, `|` gets one more
backslash before the bar, so no control string can occur there and taking that backslash away restores the text.
Slices of Arrow batches are assembled at once: segment lengths, their running sums and scatter indices are numpy arrays,
and headers and contents are copied into one preallocated buffer.

Rows are dealt by ranges of (conv_id, turn), so a conversation with a third of all turns is formatted by many tasks.
The result has one row for each stretch of a conversation within a slice, ordered by (part, seq).

Cases: null text or role is empty; turns with the same number come in the order of role and text, null turns first;
rows with a null conv_id form one conversation; an empty table gives no row; only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batched, pieces, release, utf8, utf8_lengths

START, END = "<|im_start|>", "<|im_end|>\n"
_CONST = np.frombuffer((START + "\n" + END).encode(), np.uint8)
#: Rows whose text is longer are copied as slices, without indices.
LONG = 1 << 18
#: Bytes of turns assembled at once; a longer turn has a slice of its own.
SLICE = 1 << 20
SEGMENT = "conv_id long, part int, seq long, n_turns int, formatted string, loss_spans array<struct<start:long,end:long>>"


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\\\1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def _escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role) if "\\" in role else role


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all rows, the offset of each row in them, and the code points before each of the five segments of a row, and before the end."""
    role, role_at = utf8(roles)
    text, text_at = utf8(texts)
    lengths = np.stack([np.full(len(roles), len(START)), np.diff(role_at), np.ones(len(roles), np.int64), np.diff(text_at), np.full(len(roles), len(END))], 1).astype(np.int64)
    starts = np.r_[0, np.cumsum(lengths.ravel())]
    out = np.empty(starts[-1], np.uint8)
    row_at = starts[:: lengths.shape[1]]
    for a, b in pieces(row_at, LONG):
        # one pool of sources for these rows: constants, roles, texts
        pool = [_CONST, role[role_at[a] : role_at[b]], text[text_at[a] : text_at[b]]]
        base = np.cumsum([0, *map(len, pool)])
        source = np.stack([np.zeros(b - a, np.int64), base[1] + role_at[a:b] - role_at[a], np.full(b - a, len(START)), base[2] + text_at[a:b] - text_at[a], np.full(b - a, len(START) + 1)], 1).ravel()
        size, to = lengths[a:b].ravel(), starts[a * 5 : b * 5]
        joined = np.concatenate(pool)
        if b == a + 1:
            for s, n, t in zip(source, size, to, strict=True):
                out[t : t + n] = joined[s : s + n]
        else:
            out[row_at[a] : row_at[b]] = joined[np.repeat(source - to, size) + np.arange(row_at[a], row_at[b])]
    # code points by segment, then their running sum; an empty segment has none
    points = np.add.reduceat((out & 0xC0) != 0x80, starts[:-1], dtype=np.int64) if len(out) else np.zeros(0, np.int64)
    return out, row_at, np.r_[0, np.cumsum(np.where(lengths.ravel() > 0, points, 0))]


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """rows (conv_id, turn, role, text) as formatted stretches, each with the code-point spans of the texts under the loss mask."""

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.r_[0, np.cumsum(utf8_lengths(batch.column(1)) + utf8_lengths(batch.column(2)) + 64)]
            for a, b in pieces(sizes, SLICE):
                yield stretches(batch.slice(a, b - a), part, seq)
                seq += b - a
        release()

    def stretches(batch: pa.RecordBatch, part: int, seq: int) -> pa.RecordBatch:
        conv, role = batch.column(0), batch.column(1).dictionary_encode()
        names = role.dictionary.to_pylist()
        lossy = np.array([x == loss_role for x in names])[role.indices.to_numpy(zero_copy_only=False)]
        escaped = pa.array([_escape_role(x) for x in names], pa.string())
        out, row_at, points = assemble(escape(escaped.take(role.indices)), escape(batch.column(2)))
        known, ids = conv.is_valid().to_numpy(zero_copy_only=False), conv.fill_null(0).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])])
        last = np.r_[first[1:], len(ids)]
        begin = np.flatnonzero(lossy)
        s, e = points[5 * begin + 3], points[5 * begin + 4]
        own = points[5 * first][np.searchsorted(first, begin, "right") - 1]
        spans = pa.StructArray.from_arrays([pa.array(s - own), pa.array(e - own)], ["start", "end"])
        edges = np.searchsorted(begin, np.r_[first, len(ids)]).astype(np.int32)
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(row_at[np.r_[first, len(ids)]].astype(np.int64)), pa.py_buffer(out)])
        return pa.RecordBatch.from_arrays(
            [conv.take(pa.array(first)), pa.array(np.full(len(first), part, np.int32)), pa.array(np.arange(seq, seq + len(first))), pa.array((last - first).astype(np.int32)), text.cast(pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(pa.array(edges), spans)],
            ["conv_id", "part", "seq", "n_turns", "formatted", "loss_spans"],
        )

    turn = F.col("turn").cast("long")
    text = rows.select(F.col("conv_id").cast("long"), turn.alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = text.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return batched(dealt.select("conv_id", "role", "text")).mapInArrow(form, SEGMENT)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of the turns of formatted text."""
    out = []
    for turn in formatted.split(START)[1:]:
        role, _, text = turn.partition("\n")
        out.append((_unescape_role(unescape(role)), unescape(text.removesuffix(END))))
    return out


def digests(segments: DataFrame) -> DataFrame:
    """What can be read back from the stretches, by conversation. A hash of all turns is read in order, so one task reads a conversation; it holds one batch of stretches and two hash states at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

        def close():
            n, turns, chars, loss, total = state
            done.append((now[0], n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], list(names))

        for batch in batches:
            for conv, formatted, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    loss = unescape(formatted[span["start"] : span["end"]])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(formatted)
            if done:
                yield flush()
                done = []
        if now is not None:
            close()
            yield flush()

    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return batched(dealt.select("conv_id", "formatted", "loss_spans")).mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
