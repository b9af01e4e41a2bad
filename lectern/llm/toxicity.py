"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are words and their prefixes of PREFIXES bytes, which catch the forms of one stem. Every term of every example counts,
by its frequency in the text, its rarity over all documents, and a factor from FLOOR to 1 that grows with its class evidence
(a chi-square test). An example or a document is its vector over these terms, of length 1.

The index. Examples are arranged so that alike ones are neighbours and cut into blocks. Postings are kept by term; those of the
heavy terms, which most examples share, are laid out as a slab of weights for each block, with each term's largest weight
in it. A batch of documents is searched together: the postings of all other terms are added up first, then a document's
cosine in a block is bounded by the block's largest sum so far and the maxima of the heavy terms. The blocks of the two
largest bounds give a first k-th best, and every block is opened whose bound reaches it, by one matrix product for all
documents that want it. No block that could hold a neighbour stays closed, so the neighbours are exact; cosines are held
in single precision and compared to six digits.
Votes weighted by similarity are calibrated by isotonic regression on leave-one-out votes of the examples.

Of near copies among the examples (eight tenths of their word triples, compared exactly) one is kept, so that a copied text does not pass for many witnesses.
The fit uses at most `max_rows` labelled rows (a documented bound, chosen by a hash of the id), which bounds the index.
Scoring is narrow: whole texts, no shuffle; document frequencies take one pass more.
Defined results: texts without a term of any example (null and empty texts too) get the calibrated rate of such
examples and no evidence; ties go to the example with the smallest id; without labels of both kinds every score is the
base rate (0 without any label); repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textcore as tc
from lectern.llm.common import bound_batches, fold, give_back, labelled_sample, lean, materialize, slices
from lectern.llm.jaccard import fold_vector, similarity_join

SLICE = 1 << 20
PREFIXES = (5, 7)
#: Factor of a term without class evidence, beside 1 for one of clear evidence.
FLOOR = 0.5
#: Documents that are searched together, and postings of all of them at most (one longer document stands alone).
BATCH, BATCH_POSTINGS = 64, 1 << 21
#: What single precision may take from a bound.
SLACK = 1e-5
#: Postings that are sorted at once.
PORTION = 1 << 19
EVIDENCE = "evidence array<struct<doc_id:bigint,similarity:double,toxic:int>>"


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, text by text, and where each text's begin."""
    rows, first = tc.tokenize(column, tc.ALNUM, prefixes=PREFIXES)
    return rows.T.ravel(), first * len(rows)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the best rising step function."""
    order = np.argsort(x, kind="stable")
    knots, first = np.unique(x[order], return_index=True)
    sums = np.add.reduceat(y[order], first)
    counts = np.diff(np.r_[first, len(x)]).astype(float)
    stack: list[list[float]] = []
    for k, s, c in zip(knots.tolist(), sums.tolist(), counts.tolist(), strict=True):
        stack.append([k, s, c])
        while len(stack) > 1 and stack[-2][1] * stack[-1][2] >= stack[-1][1] * stack[-2][2]:
            _, s1, c1 = stack.pop()
            stack[-1][1] += s1
            stack[-1][2] += c1
    return np.array([b[0] for b in stack]), np.array([b[1] / b[2] for b in stack])


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places first[i] to first[i] + size[i] - 1 of all i, one run after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _heavy(held: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of each of the terms of most postings, -1 for others; and these terms."""
    top = np.argsort(-held, kind="stable")[:most]
    row = np.full(len(held), -1, np.int32)
    row[top] = np.arange(len(top))
    return row, top


class _Index:
    """Blocks of a model's examples, made from its postings where they are searched.

    row, slabs, peaks: heavy terms, their weights by block, term and place, and the largest by term and block. first, size:
    the postings of any other term."""

    def __init__(self, model: NearestModel) -> None:
        width, held = model.block, np.diff(model.to).astype(np.int64)
        self.row, top = _heavy(held, model.heavy)
        blocks = -(-len(model.ids) // width)
        self.slabs = np.zeros((blocks, len(top), width), np.float32)
        for r, t in enumerate(top):
            own = slice(model.to[t], model.to[t + 1])
            block, place = np.divmod(model.places[own], width)
            self.slabs[block, r, place] = model.weights[own]
        self.peaks = np.ascontiguousarray(self.slabs.max(axis=2).T)
        held[top] = 0
        self.first, self.size = model.to[:-1].astype(np.int64), held


@dataclass
class NearestModel:
    """Examples as postings by term, and the calibration of their votes."""

    terms: np.ndarray
    idf: np.ndarray
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    block: int = 64
    k: int = 15
    rate: float = 0.0
    bare: float = 0.0
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    heavy: int = 512
    #: What is sent: for each term where its postings begin, and the places of examples with their weights.
    to: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    index: _Index | None = None
    sent: Broadcast | None = None

    def vectors(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of each text."""
        n = len(first) - 1
        if not len(self.terms):
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == hashes)
        key, times = np.unique((np.searchsorted(first, hit, "right") - 1) * len(self.terms) + at[hit], return_counts=True)
        text, term = np.divmod(key, len(self.terms))
        weight = (1 + np.log(times)) * self.idf[term].astype(float)
        weight = weight / np.sqrt(np.bincount(text, weight**2, n))[text]
        border = np.searchsorted(text, np.arange(n + 1))
        return [(term[a:b], weight[a:b]) for a, b in zip(border[:-1], border[1:], strict=True)]

    def build(self, ids: np.ndarray, toxic: np.ndarray, sizes: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Index of examples, sorted by id: sizes[i] terms with weights belong to example i, one example after the other."""
        n, width = len(ids), self.block
        held = np.bincount(term, minlength=len(self.terms))
        row, top = _heavy(held, self.heavy)
        slot = np.repeat(np.arange(n, dtype=np.int32), sizes)
        dense = np.zeros((n, len(top)), np.float32)
        at = np.flatnonzero(row[term] >= 0)
        dense[slot[at], row[term[at]]] = weight[at]
        order = _arranged(dense, width)
        place = np.empty(n, np.int32)
        place[order] = np.arange(n)
        self.ids, self.toxic = ids[order], toxic[order]
        del dense, at
        self.to = np.r_[0, np.cumsum(held)].astype(np.int32 if len(term) < 2**31 else np.int64)
        self.places, self.weights = np.empty(len(term), np.uint16 if max(n, width) < 1 << 16 else np.int32), np.empty(len(term), np.float32)
        # by portions of terms, as a sort takes several times the room of what it sorts
        edge = np.unique(np.r_[np.searchsorted(self.to, np.arange(0, len(term), PORTION)), len(held)])
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            at = np.flatnonzero((term >= lo) & (term < hi)).astype(self.to.dtype)
            spot = place[slot[at]]
            own = np.lexsort((spot, term[at]))
            here = slice(self.to[lo], self.to[hi])
            self.places[here], self.weights[here] = spot[own], weight[at[own]]
        self.index = None

    def shared(self, spark) -> Broadcast:
        """This model as one broadcast; its size is bounded by the number of examples."""
        if self.sent is None:
            self.sent = spark.sparkContext.broadcast(self)
        return self.sent

    def __getstate__(self) -> dict:
        return self.__dict__ | {"sent": None, "index": None}

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Examples of the k largest cosines, and these, for each text; skip: for each text an id that is left out."""
        size = np.array([int((self.to[t + 1] - self.to[t]).sum()) if len(t) else 0 for t, _ in texts])
        lo = 0
        while lo < len(texts):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo : lo + BATCH]), BATCH_POSTINGS, "right")))
            yield from self.search(texts[lo:hi], None if skip is None else skip[lo:hi])[0]
            lo = hi

    def search(self, texts: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int, int]:
        """The same for one batch, with how many blocks of texts were opened, of how many."""
        n, width, total = len(texts), self.block, len(self.ids)
        if not total or not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * n, 0, 0
        if self.index is None:
            self.index = _Index(self)
        index, blocks = self.index, len(self.index.slabs)
        query = np.zeros((n, index.slabs.shape[1]), np.float32)
        found = np.zeros((n, blocks * width), np.float32)
        for i, (terms, weights) in enumerate(texts):
            row = index.row[terms]
            query[i, row[row >= 0]] = weights[row >= 0]
            terms, weights = terms[row < 0], weights[row < 0].astype(np.float32)
            size = index.size[terms]
            spot = _runs(index.first[terms], size)
            found[i] = np.bincount(self.places[spot], np.repeat(weights, size) * self.weights[spot], blocks * width)
        bound = query @ index.peaks + found.reshape(n, blocks, width).max(axis=2)
        left_out = [(i, np.flatnonzero(self.ids == x)) for i, x in enumerate(skip or ())]

        def opened(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                rows = np.flatnonzero(wanted[:, b])
                found[rows, b * width : (b + 1) * width] += query[rows] @ index.slabs[b]

        usual = bound > 0
        first = np.zeros_like(usual)
        np.put_along_axis(first, np.argpartition(-bound, min(2, blocks) - 1, axis=1)[:, :2], True, axis=1)
        first &= usual
        opened(first)
        for i, places in left_out:
            found[i, places] = 0
        k = min(self.k, found.shape[1])
        # what stands in closed blocks is a part of its cosine, so this is a lower bound of the k-th best
        least = np.partition(found, -k, axis=1)[:, -k]
        rest = usual & ~first & (bound >= np.maximum(least[:, None] - SLACK, 0))
        opened(rest)
        for i, places in left_out:
            found[i, places] = 0
        least = np.partition(found, -k, axis=1)[:, -k]
        out = []
        for i in range(n):
            at = np.flatnonzero(found[i, :total] > max(least[i] - SLACK, 0))
            s = np.round(found[i, at].astype(float), 6)
            pick = np.lexsort((self.ids[at], -s))[: self.k]
            out.append((at[pick], s[pick]))
        return out, int(first.sum() + rest.sum()), int(usual.sum())

    def vote(self, i: np.ndarray, s: np.ndarray) -> float:
        """Share of toxic neighbours by weight 1 / (1 + distance)^2, drawn to the base rate where they are far."""
        weight = s / (1 + np.sqrt(np.maximum(2 - 2 * s, 0))) ** 2
        return float((weight @ self.toxic[i] + 0.5 * self.rate) / (weight.sum() + 0.5))


def _arranged(x: np.ndarray, width: int) -> np.ndarray:
    """Rows so that alike ones are neighbours: halved along the direction of most variance until a part is a block."""
    parts, out = [np.arange(len(x))], []
    while parts:
        own = parts.pop()
        if len(own) <= width:
            out.append(own)
            continue
        y = x[own]
        y -= y.mean(axis=0)
        v = y[int(np.argmax((y * y).sum(axis=1)))].copy()
        for _ in range(8):
            v = y.T @ (y @ v)
            v /= max(float(np.linalg.norm(v)), 1e-30)
        # whole blocks, so that no part ends inside one
        half = max(width, len(own) // 2 // width * width)
        order = own[np.argsort(y @ v, kind="stable")]
        parts += [order[half:], order[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def calibrated(model: NearestModel, votes: np.ndarray) -> np.ndarray:
    return np.interp(votes, model.knots, model.values) if len(model.knots) else np.full(len(votes), model.rate)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held: int = 1, max_rows: int = 6_000, significance: float = 3.5) -> NearestModel:
    """Fit on at most max_rows labelled documents outside the held-out fold; a term's evidence is clear from a chi-square
    of significance * log2(rows) on, which allows for the number of terms tried."""
    sample = labelled_sample(labels, label, modulus, held, max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")
    texts = _alone(texts)

    def counts(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                hashes, first = _terms(part.column("text"))
                y = part.column("y").to_numpy() > 0
                own = [x[x > 0] for x in (np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True))]
                terms, at = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]), return_inverse=True)
                flag = np.repeat(y, [len(x) for x in own])
                n1 = np.bincount(at, flag, len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n1), pa.array(np.bincount(at, minlength=len(terms)) - n1)], names=["term", "n1", "n0"])

    size = texts.groupBy("y").count().collect()
    pos, neg = (float(sum(r["count"] for r in size if (r["y"] > 0) == flag)) for flag in (True, False))
    model = NearestModel(np.zeros(0, np.uint64), np.zeros(0), rate=pos / (pos + neg) if pos + neg else 0.0)
    model.bare = model.rate
    if not pos or not neg:
        return model
    df = texts.mapInArrow(lean(counts), "term bigint, n1 bigint, n0 bigint").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).toArrow()
    if not df.num_rows:
        model.bare = model.rate
        return model
    terms = df.column("term").to_numpy().view(np.uint64)
    order = np.argsort(terms)
    n1, n0 = (df.column(c).to_numpy()[order].astype(float) for c in ("n1", "n0"))
    n, both = pos + neg, n1 + n0
    chi = n * (n1 * neg - n0 * pos) ** 2 / (both * np.maximum(n - both, 1) * pos * neg)
    evidence = np.minimum(1.0, chi / (significance * float(np.log2(n))))
    evidence[both < 3] = 0
    total, seen = _frequencies(docs, terms[order])
    model.terms = terms[order]
    model.idf = (np.log1p(total / np.maximum(seen, both)) * (FLOOR + (1 - FLOOR) * evidence)).astype(np.float32)

    del df, terms, order, n1, n0, both, chi, evidence, seen

    def examples(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                own = model.vectors(*_terms(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), *(pa.array([x[k].astype(t).tobytes() for x in own], pa.binary()) for k, t in ((0, np.int32), (1, np.float32)))], names=["doc_id", "y", "terms", "weights"])

    give_back()
    found = texts.mapInArrow(lean(examples), "doc_id bigint, y int, terms binary, weights binary").toArrow()
    found = found.filter(pa.compute.greater(pa.compute.binary_length(found.column("terms")), 0)) if found.num_rows else found
    some = found.num_rows
    toxic = int(pa.compute.sum(pa.compute.greater(found.column("y"), 0)).as_py() or 0)
    model.bare = (pos - toxic + model.rate) / (n - some + 1)
    if some:
        order = pa.compute.sort_indices(found, [("doc_id", "ascending"), ("y", "ascending"), ("terms", "ascending")])
        take = lambda c: found.column(c).take(order)
        flat = lambda c, t: np.concatenate([np.frombuffer(v.as_buffer(), t) for v in take(c)])
        term, weight, sizes = flat("terms", np.int32), flat("weights", np.float32), pa.compute.binary_length(take("terms")).to_numpy() // 4
        ids, y = take("doc_id").to_numpy(), (take("y").to_numpy() > 0).astype(float)
        del found, order
        give_back()
        model.build(ids, y, sizes, term, weight)
        del term, weight, sizes
        give_back()
        sent = model.shared(docs.sparkSession)

        def left_out(batches):
            own = sent.value
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    texts = [x for x in zip(part.column("doc_id").to_pylist(), part.column("y").to_pylist(), own.vectors(*_terms(part.column("text"))), strict=True) if len(x[2][0])]
                    rows = [(i, y, own.vote(*near)) for (i, y, _), near in zip(texts, own.nearest([v for *_, v in texts], [i for i, *_ in texts]), strict=True)]
                    cols = zip(*rows, strict=True) if rows else [[]] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64()), strict=True)], names=["doc_id", "y", "vote"])

        # one number for each example, whose own text takes no part in its vote
        votes = texts.mapInArrow(lean(left_out), "doc_id bigint, y int, vote double").toArrow().sort_by([("vote", "ascending"), ("y", "ascending")])
        knots, values = isotonic(votes.column("vote").to_numpy(), (votes.column("y").to_numpy() > 0).astype(float))
        model.knots, model.values = np.r_[knots, 1.0], np.r_[values, values[-1]]
    give_back()
    return model


def _frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """Documents, and how many of them hold each of the sorted terms."""
    size = -(-(len(terms) + 1) // 16) * 16

    def add(total: np.ndarray, batch) -> None:
        for part in slices(batch, "text", SLICE):
            hashes, first = _terms(part.column("text"))
            at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
            hit = np.flatnonzero(terms[at] == hashes)
            key = np.unique((np.searchsorted(first, hit, "right") - 1) * len(terms) + at[hit])
            total[: len(terms)] += np.bincount(key % len(terms), minlength=len(terms))
            total[len(terms)] += part.num_rows

    found = fold_vector(docs.select(F.col("text").cast("string").alias("text")), add, size, "int64", "add")
    return int(found[len(terms)]), found[: len(terms)].astype(float)


def _alone(texts: DataFrame) -> DataFrame:
    """Labelled texts without near copies: of those that share eight tenths of their word triples, the smallest id stays."""
    texts = materialize(texts, "labelled")
    gone = similarity_join(texts, k=3, num=80, den=100).filter("doc_id <> component_id").select("doc_id").distinct()
    return materialize(texts.join(gone, "doc_id", "left_anti"), "examples")


def score(docs: DataFrame, model: NearestModel, modulus: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (nearest examples) for each row."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), modulus) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
    sent = model.shared(docs.sparkSession)
    # the broadcast may be older than the calibration
    scale = NearestModel(model.terms[:0], model.idf[:0], rate=model.rate, bare=model.bare, knots=model.knots, values=model.values)

    def run(batches):
        own = sent.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                scores, evidence = np.full(part.num_rows, scale.bare), [[]] * part.num_rows
                texts = own.vectors(*_terms(part.column("text")))
                some = [n for n, (terms, _) in enumerate(texts) if len(terms)]
                for n, (i, s) in zip(some, own.nearest([texts[n] for n in some]), strict=True):
                    scores[n] = calibrated(scale, np.array([own.vote(i, s)]))[0]
                    evidence[n] = [{"doc_id": int(own.ids[j]), "similarity": float(x), "toxic": int(own.toxic[j])} for j, x in zip(i[:5], s[:5], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores), pa.array(evidence, kind)], names=["doc_id", "held_out", "score", "evidence"])

    scored = rows.mapInArrow(lean(run), f"doc_id bigint, held_out boolean, score double, {EVIDENCE}")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
