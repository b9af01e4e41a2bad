"""Many literals sought in one pass over each text: an Aho-Corasick automaton inside Arrow batches.

Literals travel to the tasks as one broadcast of at most MOST_CHARS characters; a longer list takes one scan for each such
portion, and only a portion at a time is held by the driver. A worker builds an automaton once and keeps it.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CHARS = 16_000_000
#: The automaton that this worker used last.
_BUILT: dict[str, object] = {}


def _automaton(key: str, literals: list[str]):
    import ahocorasick

    if key not in _BUILT:
        _BUILT.clear()
        built = ahocorasick.Automaton()
        for n, literal in enumerate(literals):
            built.add_word(literal, (n, len(literal)))
        built.make_automaton()
        _BUILT[key] = built
    return _BUILT[key]


def _matches(automaton, text: str) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of all matches by their end; matches of one literal do not overlap each other."""
    free: dict[int, int] = {}
    for last, (n, size) in automaton.iter(text):
        start = last + 1 - size
        if start >= free.get(n, 0):
            free[n] = last + 1
            yield n, start, last + 1


def folded(text: str) -> str:
    """Small letters, character by character: what has no single small letter stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _bytes_before(text: str) -> np.ndarray:
    """Bytes of UTF-8 before each character, and of the whole text."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.r_[0, np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))]


def covered(rows: DataFrame, keys: list[str], text: str, literals: list[str]) -> DataFrame:
    """(keys, start, end): the byte ranges that matches of any literal cover without regard to case, overlapping or touching
    ones as one. literals: a short list, in small letters."""
    given = rows.select(*keys, F.col(text).cast("string").alias("_text"))
    key = uuid.uuid4().hex

    def run(batches):
        automaton = _automaton(key, literals)
        for batch in batches:
            row, begins, ends = [], [], []
            for i, value in enumerate(batch.column("_text").to_pylist()):
                if not value:
                    continue
                found = sorted((a, z) for _, a, z in _matches(automaton, folded(value)))
                if not found:
                    continue
                a, z = (np.array(x) for x in zip(*found, strict=True))
                reach = np.maximum.accumulate(z)
                opens = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
                a, z = a[opens], reach[np.r_[opens[1:] - 1, len(a) - 1]]
                if not value.isascii():
                    before = _bytes_before(value)
                    a, z = before[a], before[z]
                row.append(np.full(len(a), i))
                begins.append(a)
                ends.append(z)
            at, a, z = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (row, begins, ends))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at)) for k in keys), pa.array(a), pa.array(z)], names=[*keys, "start", "end"])

    kinds = ", ".join(f"`{k}` {kind}" for k, kind in given.dtypes if k in keys)
    return given.mapInArrow(run, f"{kinds}, start bigint, end bigint")


def _best_window(found: list[tuple[int, int, int]], size: int) -> tuple[int, int]:
    """Start of the first match and end of the last one of the window that holds the most different literals, then the most
    matches, then stands first; found: (start, end, number), sorted. Both ends of the window only move forward."""
    seen: dict[int, int] = {}
    best, j, reach = None, 0, 0
    for i, (start, _, number) in enumerate(found):
        while j < len(found) and found[j][1] <= start + size:
            seen[found[j][2]] = seen.get(found[j][2], 0) + 1
            reach = max(reach, found[j][1])
            j += 1
        rank = (-len(seen), i - j, start)
        best = min(best, (*rank, reach)) if best else (*rank, reach)
        seen[number] -= 1
        if not seen[number]:
            del seen[number]
    return best[2], best[3]


def fragments(rows: DataFrame, keys: list[str], text: str, literals: list[str], size: int = 34) -> DataFrame:
    """(keys, snippet): the stretch of `size` characters (more if a literal is longer) in which the most of the literals meet,
    with the matches in its middle and an ellipsis where text is left out; null without a match. literals: small letters."""
    given = rows.select(*keys, F.col(text).cast("string").alias("_text"))
    key, size = uuid.uuid4().hex, max([size, *map(len, literals)])

    def cut(automaton, value: str | None) -> str | None:
        found = sorted((a, z, n) for n, a, z in _matches(automaton, folded(value or "")))
        if not found:
            return None
        first, last = _best_window(found, size)
        start = max(0, min(first - (size - (last - first)) // 2, len(value) - size))
        return ("…" if start else "") + value[start : start + size] + ("…" if start + size < len(value) else "")

    def run(batches):
        automaton = _automaton(key, literals)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([cut(automaton, v) for v in batch.column("_text").to_pylist()], pa.string())], names=[*keys, "snippet"])

    kinds = ", ".join(f"`{k}` {kind}" for k, kind in given.dtypes if k in keys)
    return given.mapInArrow(run, f"{kinds}, snippet string")


def _portions(quotes: DataFrame, most: int) -> Iterator[dict[str, list]]:
    """Literals with the ids that share them, by portions of at most `most` characters (one longer literal stands alone)."""
    held: dict[str, list] = {}
    size = 0
    for row in quotes.groupBy("quote").agg(F.collect_set("item_id").alias("ids")).toLocalIterator():
        if held and size + len(row["quote"]) > most:
            yield held
            held, size = {}, 0
        held[row["quote"]] = sorted(row["ids"])
        size += len(row["quote"])
    if held:
        yield held


def counts(documents: DataFrame, quotes: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """(item_id, doc_id, n): how often each quotation (item_id, quote) stands in each document (doc_id, text), as literals."""
    spark = documents.sparkSession
    kinds = dict(documents.dtypes)["doc_id"], dict(quotes.dtypes)["item_id"]
    schema = f"item_id {kinds[1]}, doc_id {kinds[0]}, n bigint"
    given = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    item_kind = pa.string() if kinds[1] == "string" else pa.int32() if kinds[1] == "int" else pa.int64()

    def one(portion: dict[str, list]) -> DataFrame:
        sent, key = spark.sparkContext.broadcast(portion), uuid.uuid4().hex

        def run(batches):
            ids = list(sent.value.values())
            automaton = _automaton(key, list(sent.value))
            for batch in batches:
                rows, items, times = [], [], []
                for i, value in enumerate(batch.column("text").to_pylist()):
                    found: dict[int, int] = {}
                    for n, _, _ in _matches(automaton, value or ""):
                        found[n] = found.get(n, 0) + 1
                    for n, k in found.items():
                        rows += itertools.repeat(i, len(ids[n]))
                        items += ids[n]
                        times += itertools.repeat(k, len(ids[n]))
                yield pa.RecordBatch.from_arrays([pa.array(items, item_kind), batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(times, pa.int64())], names=["item_id", "doc_id", "n"])

        return given.mapInArrow(run, schema)

    out = None
    for portion in _portions(quotes.filter("length(quote) > 0").select("item_id", "quote"), most_chars):
        out = one(portion) if out is None else out.unionByName(one(portion))
    return spark.createDataFrame([], schema) if out is None else out
