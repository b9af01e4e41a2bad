"""Benchmark decontamination by a distributed positional inverted index.

`build_index` turns documents into stored index segments: for each term (a word's hash) the sorted positions of its tokens.
Segments are cut by documents, as the lists that a window intersects must lie in one place; inside a segment terms are
sorted, so that a term is found by bisection. `search` reads the stored index, takes a window's lists from its rarest term
in that segment on, adjusts them by the term's offset in the window, intersects them, and returns exact phrase matches and
proximity matches (all but `slop` words of a window in their places).

The corpus is read once, whatever the benchmark's size; nothing is shuffled and nothing document-sized is broadcast. The
items are a stated query set: a block of them is sent to the executors only up to `block_bytes` of text; more items are
searched block by block in the stored index and merged by document. Of a block, a segment first learns which terms it
holds; only windows that can match there cost more, and their candidates are made in portions of CANDIDATES.
Defined results: null or empty texts have no words and no hits; items without words or without id match nothing;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textcore as tc
from lectern.llm.common import bound_batches, lean, materialize, slices

SEGMENT_BYTES = 2 << 20
BLOCK_BYTES = 2 << 20
CANDIDATES = 1 << 20
SEGMENT = "doc_id array<bigint>, row_key array<bigint>, doc_end binary, terms binary, sizes binary, steps binary"
MATCH = "doc_id bigint, row_key bigint, n_words bigint, n_hit bigint, spans array<struct<start:bigint,end:bigint>>, items array<bigint>, near_items array<bigint>"


@dataclass
class Windows:
    """Distinct windows of a block of items: rows of places in the sorted vocabulary (-1 beyond a short one's end), their
    lengths, and the ids of the items that hold each, from first[i] to first[i + 1]."""

    vocabulary: np.ndarray
    grams: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    owners: np.ndarray


def windows(items: list[tuple[int, str]], size: int) -> Windows:
    hashes, starts = tc.tokenize(pa.array([t for _, t in items], pa.string()), tc.ALNUM)
    vocabulary, place = np.unique(hashes, return_inverse=True)
    n = np.diff(starts)
    # a text of n words has n - size + 1 windows, a shorter one that is not empty has one
    each = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    item = np.repeat(np.arange(len(items)), each)
    begin = starts[:-1][item] + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    at = begin[:, None] + np.arange(size)
    inside = at < starts[1:][item][:, None]
    grams = np.where(inside, place[np.minimum(at, max(len(place) - 1, 0))] if len(place) else 0, -1).astype(np.int32).reshape(-1, size)
    grams, which = np.unique(grams, axis=0, return_inverse=True)
    ids = np.array([i for i, _ in items], np.int64)
    pairs = np.unique(np.stack([which.ravel(), ids[item]], axis=1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
    return Windows(vocabulary, grams, (grams >= 0).sum(axis=1), np.searchsorted(pairs[:, 0], np.arange(len(grams) + 1)), pairs[:, 1])


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Index segments of documents, with all their terms."""

    def segments(batches):
        for batch in batches:
            for part in slices(batch, "text", segment_bytes):
                yield _segment(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(segments), SEGMENT)


def _segment(part: pa.RecordBatch) -> pa.RecordBatch:
    hashes, starts = tc.tokenize(part.column("text"), tc.ALNUM)
    n_docs = part.num_rows
    order = np.argsort(hashes, kind="stable")
    # positions leave a gap between documents, so that no run of positions crosses one
    position = (order + np.searchsorted(starts, order, "right") - 1).astype(np.int64)
    hashes = hashes[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    # positions are stored as steps from one to the next, which are small
    steps = np.diff(position, prepend=0)
    steps[first] = position[first]
    kind = np.int32 if len(hashes) + n_docs < 2**31 else np.int64
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            pa.array([part.column("row_key").to_pylist()], pa.list_(pa.int64())),
            pa.array([(starts[1:] + np.arange(n_docs)).astype(np.int64).tobytes()], pa.binary()),
            pa.array([hashes[first].tobytes()], pa.binary()),
            pa.array([np.diff(np.r_[first, len(hashes)]).astype(kind).tobytes()], pa.binary()),
            pa.array([steps.astype(kind).tobytes()], pa.binary()),
        ],
        names=["doc_id", "row_key", "doc_end", "terms", "sizes", "steps"],
    )


def _postings(row: dict, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all terms one after the other, and where each term's begin and end."""
    kind = np.int32 if len(row["sizes"]) == 4 * len(terms) else np.int64
    ends = np.cumsum(np.frombuffer(row["sizes"], kind), dtype=np.int64)
    first = np.r_[0, ends[:-1]] if len(ends) else ends
    run = np.cumsum(np.frombuffer(row["steps"], kind), dtype=np.int64)
    # each term's steps begin anew
    return run - np.repeat(np.where(first > 0, run[np.maximum(first - 1, 0)], 0), ends - first) if len(run) else run, first, ends


def _locate(terms: np.ndarray, postings, span: int, query: Windows, slop: int):
    """(window, start, words in place) of matches with at most `slop` words out of place, in portions."""
    size = query.grams.shape[1]
    if not len(terms) or not len(query.grams):
        return
    rank = np.minimum(np.searchsorted(terms, query.vocabulary), len(terms) - 1)
    held = terms[rank] == query.vocabulary
    allowed = np.where(query.lengths == size, slop, 0)  # windows shorter than the size match exactly only
    known = held[query.grams] & (query.grams >= 0)
    alive = np.flatnonzero((known.sum(axis=1) >= query.lengths - allowed) & (query.lengths > 0))
    if not len(alive):
        return
    positions, first, ends = postings()
    # the places of these windows' terms alone
    used = np.unique(query.grams[alive][known[alive]])
    sizes = (ends - first)[rank[used]]
    total = np.cumsum(sizes)
    begin_of = np.zeros(len(query.vocabulary), np.int64)
    size_of = np.zeros(len(query.vocabulary), np.int64)
    begin_of[used], size_of[used] = total - sizes, sizes
    positions = positions[np.repeat(first[rank[used]] - (total - sizes), sizes) + np.arange(int(total[-1]))]
    number = np.zeros(len(query.vocabulary), np.int64)
    number[used] = np.arange(len(used))
    keys = np.repeat(np.arange(len(used), dtype=np.int64), sizes) * span + positions
    grams, known, lengths, allowed = query.grams[alive], known[alive], query.lengths[alive], allowed[alive]
    freq = np.where(known, size_of[grams], 0)
    # rarest first; words beyond the window's end come last
    order = np.argsort(np.where(np.arange(size) < lengths[:, None], freq, np.iinfo(np.int64).max), axis=1, kind="stable")
    rows = np.arange(len(alive))
    # a match misses at most slop words, so one of the slop + 1 rarest is in its place
    lead = [(order[:, j], (j <= allowed) & (j < lengths) & known[rows, order[:, j]]) for j in range(min(slop + 1, size))]
    cost = np.cumsum(sum(np.where(use, freq[rows, o], 0) for o, use in lead))
    edge = [0]
    while edge[-1] < len(alive):
        done = cost[edge[-1] - 1] if edge[-1] else 0
        edge.append(max(edge[-1] + 1, int(np.searchsorted(cost, done + CANDIDATES, "right"))))
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        which, begin = [], []
        for o, use in lead:
            w = np.flatnonzero(use[lo:hi]) + lo
            f, a = freq[w, o[w]], begin_of[grams[w, o[w]]]
            at = np.repeat(a - (np.cumsum(f) - f), f) + np.arange(int(f.sum()))
            which.append(np.repeat(w, f))
            begin.append(positions[at] - np.repeat(o[w], f))
        both = np.concatenate(which) * span + np.concatenate(begin) + size
        which, begin = np.divmod(np.unique(both) if len(lead) > 1 else both, span)
        begin -= size
        hits = np.zeros(len(which), np.int64)
        for j in range(size):
            o = order[which, j]
            want = number[grams[which, o]] * span + begin + o
            found = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hits += (j < lengths[which]) & known[which, o] & (begin + o >= 0) & (keys[found] == want)
            keep = hits + allowed[which] >= np.minimum(j + 1, lengths[which])
            which, begin, hits = which[keep], begin[keep], hits[keep]
        yield alive[which], begin, hits


def search(index: DataFrame, items: list[tuple[int, str]], window: int = 10, slop: int = 2) -> DataFrame:
    """Per document: words, words inside exact matches and their spans, items that match exactly, items that match nearly."""
    query = windows(items, window)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield _search_segment(batch.slice(i, 1).to_pylist()[0], query, slop)

    return index.mapInArrow(lean(run), MATCH)


def _search_segment(row: dict, query: Windows, slop: int) -> pa.RecordBatch:
    ends, terms = np.frombuffer(row["doc_end"], np.int64), np.frombuffer(row["terms"], np.uint64)
    size, n_docs = query.grams.shape[1], len(ends)
    begin_doc = np.r_[0, ends[:-1] + 1] if n_docs else ends
    span = int(ends[-1] if n_docs else 0) + 3 * size + 2
    cover = np.zeros(span + 1, np.int32)
    found: list[set[int]] = [set() for _ in range(n_docs)]
    near: list[set[int]] = [set() for _ in range(n_docs)]
    for which, begin, hits in _locate(terms, lambda: _postings(row, terms), span, query, slop):
        # a near match may miss its first or last word: it must still lie within one document
        doc = np.minimum(np.searchsorted(ends, np.maximum(begin, 0), "left"), n_docs - 1)
        inside = (begin >= begin_doc[doc]) & (begin + query.lengths[which] <= ends[doc])
        which, begin, hits, doc = which[inside], begin[inside], hits[inside], doc[inside]
        exact = hits == query.lengths[which]
        np.add.at(cover, begin[exact], 1)
        np.add.at(cover, begin[exact] + query.lengths[which[exact]], -1)
        for own, to in ((exact, found), (~exact, near)):
            for d, w in np.unique(np.stack([doc[own], which[own]], axis=1), axis=0).tolist():
                to[d].update(query.owners[query.first[w] : query.first[w + 1]].tolist())
    covered = np.cumsum(cover) > 0
    total = np.r_[0, np.cumsum(covered)]
    n_hit = total[ends] - total[begin_doc] if n_docs else ends
    spans: list[list[dict]] = [[] for _ in range(n_docs)]
    if covered.any():
        edge = np.diff(np.r_[0, covered.astype(np.int8), 0])
        at, to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for a, b, d in zip(at.tolist(), to.tolist(), np.searchsorted(ends, at, "left").tolist(), strict=True):
            spans[d].append({"start": a - int(begin_doc[d]), "end": b - int(begin_doc[d])})
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row["doc_id"], pa.int64()),
            pa.array(row["row_key"], pa.int64()),
            pa.array(ends - begin_doc, pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            pa.array([sorted(x) for x in found], pa.list_(pa.int64())),
            pa.array([sorted(x - y) for x, y in zip(near, found, strict=True)], pa.list_(pa.int64())),
        ],
        names=["doc_id", "row_key", "n_words", "n_hit", "spans", "items", "near_items"],
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 2, block_bytes: int = BLOCK_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Exact and near matches of benchmark windows in each document (columns of MATCH)."""
    bound_batches(docs.sparkSession)
    index = materialize(build_index(docs, segment_bytes), "index", blobs=True)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n_blocks = max(1, -(-int(total) // block_bytes))
    if n_blocks == 1:
        return search(index, _rows(items), window, slop)
    out = None
    for i in range(n_blocks):
        part = search(index, _rows(items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == i)), window, slop)
        # what a block does not hit needs no merging; the first block speaks for all rows
        part = part if i == 0 else part.filter("n_hit > 0 or size(near_items) > 0")
        out = part if out is None else out.unionByName(part)
    # identical rows (same id, same text) are merged into one and given back as often as they stand in docs
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key")).groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("n"))
    merged = out.groupBy("doc_id", "row_key").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items")
    )
    # spans of different blocks may overlap: the hit words are the union, folded from left to right
    folded = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], acc["to"]))).alias("n"), F.greatest(acc["to"], s["end"]).alias("to")),
    )
    merged = merged.withColumn("n_hit", folded["n"]).withColumn("near_items", F.array_except("near_items", "items"))
    key = merged["doc_id"].eqNullSafe(keyed["doc_id"]) & merged["row_key"].eqNullSafe(keyed["row_key"])
    merged = merged.join(keyed, key).select(merged["*"], keyed["n"])
    return merged.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("doc_id", "row_key", "n_words", "n_hit", "spans", "items", "near_items")


def _rows(items: DataFrame) -> list[tuple[int, str]]:
    return [(r["item_id"], r["text"]) for r in items.toLocalIterator()]
