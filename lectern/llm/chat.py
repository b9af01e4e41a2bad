"""Chat formatting by columnar byte assembly.

Each turn becomes `<|im_start|>role\\n` + text + `<|im_end|>\\n`. For a batch of turns the lengths of all segments, their
cumulative offsets and the target index of every source byte are computed in numpy, and headers and texts are copied into
one preallocated buffer that becomes the Arrow column's data.

Control strings inside texts are escaped reversibly: a backslash goes between the first character of `<|`, `<s>`, `</s>`,
`[INST]`, `[/INST]` and the rest; where backslashes stand there already, one more is added, so that removing one gives
the text back. In roles, a backslash and a newline are escaped as well.

Scale: rows are dealt by conversation and sorted within partitions; the assembly streams over them. A conversation is one
row, or several parts of at most about `part_bytes` each, so memory does not grow with a conversation. The loss mask is a
list of code point ranges of the assistant's texts.
Defined results: null texts and roles are empty; rows of a conversation stand by turn (nulls first), ties by role and
text; repeated rows are repeated turns; a null id is a conversation of its own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, lean
from lectern.llm.textcore import buffers

START, END = "<|im_start|>", "<|im_end|>\n"
PART_BYTES = 4 << 20
SCATTER = 1 << 20
SCHEMA = "conv_id bigint, part int, n_turns bigint, formatted string, loss_start array<bigint>, loss_end array<bigint>"

_ESCAPE = r"(<\\*)(\||/?s>)|(\[\\*)(/?INST\])"
_UNESCAPE = re.compile(r"(<\\*)\\(\||/?s>)|(\[\\*)\\(/?INST\])")


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, _ESCAPE, r"\1\3\\\2\4")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: (m[1] or m[3]) + (m[2] or m[4]), text) if "\\" in text else text


def escape_role(column: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(text: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\\" if m[1] == "\\" else "\n", unescape(text))


def assemble(columns: list[pa.Array | bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """One buffer that holds, row by row, the segments of all columns (constants stand for every row), and row ends."""
    parts = []
    for c in columns:
        if isinstance(c, bytes):
            parts.append((np.frombuffer(c, np.uint8), np.zeros(n, np.int64), np.full(n, len(c), np.int64)))
        else:
            data, offsets = buffers(c)
            parts.append((data, offsets[:-1], np.diff(offsets)))
    lengths = np.stack([p[2] for p in parts], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape) if n else lengths
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for j, (data, source, length) in enumerate(parts):
        # index vectors are eight times the bytes they place: they are made for about SCATTER bytes at a time
        total = np.cumsum(length)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SCATTER, "right")))
            if hi == lo + 1:
                out[starts[lo, j] : ends[lo, j]] = data[source[lo] : source[lo] + length[lo]]
            else:
                size = length[lo:hi]
                within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                out[np.repeat(starts[lo:hi, j], size) + within] = data[np.repeat(source[lo:hi], size) + within]
            lo = hi
    return out, ends[:, -1] if n else np.zeros(0, np.int64)


def _turns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row ends, and code points of header and text of each turn."""
    role = escape_role(batch.column("role").fill_null(""))
    text = escape(batch.column("text").fill_null(""))
    data, ends = assemble([START.encode(), role, b"\n", text, END.encode()], batch.num_rows)
    head = pc.utf8_length(role).to_numpy(zero_copy_only=False).astype(np.int64) + len(START) + 1
    return data, ends, head, pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)


def format_chat(conversations: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Formatted conversations (columns of SCHEMA), parts of a conversation in order and in one partition."""
    bound_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        state = _Writer(part_bytes)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                yield from state.add(batch.slice(lo, 1024))
        yield from state.close()

    return rows.mapInArrow(lean(run), SCHEMA)


class _Writer:
    """Cuts a stream of turns into parts: where the conversation changes, or after the turn that fills a part."""

    def __init__(self, part_bytes: int) -> None:
        self.limit, self.conv, self.part, self.open = part_bytes, None, 0, False
        self._clear()

    def _clear(self) -> None:
        self.pieces, self.bytes, self.turns, self.chars, self.loss = [], 0, 0, 0, []

    def add(self, batch: pa.RecordBatch):
        data, ends, head, body = _turns(batch)
        conv, role = batch.column("conv_id").to_pylist(), batch.column("role").to_pylist()
        done, lo, rows = [], 0, ends.tolist()
        for i, (c, r, to, h, b) in enumerate(zip(conv, role, rows, head.tolist(), body.tolist(), strict=True)):
            if not self.open or c != self.conv:
                if self.open and self.turns:
                    done.append(self._row())
                self.conv, self.part, self.open = c, 0, True
            start = rows[i - 1] if i else 0
            if not self.pieces or lo != start or self.pieces[-1][2] is not data:
                self.pieces.append([start, to, data])
            else:
                self.pieces[-1][1] = to
            lo = to
            if r == "assistant":
                self.loss.append((self.chars + h, self.chars + h + b))
            self.bytes += to - start
            self.turns += 1
            self.chars += h + b + len(END)
            if self.bytes >= self.limit:
                done.append(self._row())
                self.part += 1
        # what stays open must not hold on to the batch
        self.pieces = [[0, z - a, d[a:z].copy()] for a, z, d in self.pieces]
        if done:
            yield _batch(done)

    def close(self):
        if self.open and self.turns:
            yield _batch([self._row()])

    def _row(self) -> tuple:
        row = (self.conv, self.part, self.turns, [d[a:z] for a, z, d in self.pieces], self.loss)
        self._clear()
        return row


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    data = np.concatenate([p for r in rows for p in r[3]])
    ends = np.cumsum([sum(len(p) for p in r[3]) for r in rows])
    text = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    spans = lambda k: pa.array([[s[k] for s in r[4]] for r in rows], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), text, spans(0), spans(1)], names=["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_end"])


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted part."""
    out = []
    for turn in formatted.split(START)[1:]:
        role, text = turn.split("\n", 1)
        out.append((unescape_role(role), unescape(text[: -len(END)])))
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from format_chat's output: turns, digests of turns and of the text under the mask."""

    def run(batches):
        conv, state, live = None, None, False
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if not live or row["conv_id"] != conv:
                    if live:
                        done.append((conv, state))
                    conv, state, live = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                text = row["formatted"]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for a, z in zip(row["loss_start"], row["loss_end"], strict=True):
                    said = unescape(text[a:z])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if done:
                yield _digest_batch(done)
        if live:
            yield _digest_batch([(conv, state)])

    return formatted.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(lean(run), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _digest_batch(done: list[tuple]) -> pa.RecordBatch:
    cols = [[c for c, _ in done], [s[0] for _, s in done], [s[1].hexdigest() for _, s in done], [s[2] for _, s in done], [s[3].hexdigest() for _, s in done], [s[4] for _, s in done]]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
