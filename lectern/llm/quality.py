"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees learns one lookup table per feature and one grid per pair of features; a score is the
sum of the bins' entries through a sigmoid. Features describe the whole text, never its label, language, source or id.

The fit uses at most `max_rows` labelled rows (a documented bound, chosen by a hash of the id); only their feature rows
reach the driver. Scoring is narrow: one pass, no shuffle.
Defined results: null and empty texts have the features of an empty text and get its score; without labels of both kinds
every score is the base rate (0.5 without any label); repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textcore as tc
from lectern.llm.common import bound_batches, fold, labelled_sample, lean, slices

SLICE = 1 << 20
CLASSES = ("upper", "lower", "digit", "space", "newline", "stop", "mark", "symbol", "high")
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "newline", "stop", "mark", "symbol", "high",
    "distinct_words", "top_word", "repeated_trigrams", "repeated_lines", "line_words", "long_words", "short_words", "caps_words",
)


def _classes() -> np.ndarray:
    table = np.full(256, CLASSES.index("symbol"), np.uint8)
    table[128:] = CLASSES.index("high")
    for name, chars in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", b" \t\r\x0b\x0c"), ("newline", b"\n"), ("stop", b".,;:'\"-()"), ("mark", b"!?")):
        table[list(chars)] = CLASSES.index(name)
    return table


_CLASS = _classes()


def _per_text(values: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring borders."""
    some = np.flatnonzero(border[1:] > border[:-1])
    out = np.zeros(len(border) - 1, np.int64)
    if len(some):
        out[some] = np.add.reduceat(values, border[some], dtype=np.int32)
    return out


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    hashes, first, starts, ends, data, offsets = tc.tokenize(column, tc.SPACE, places=True)
    lines, line_first = tc.tokenize(column, tc.LINE, folded=False)
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    code = _CLASS[data]
    counts = np.zeros((n, len(CLASSES)))
    for c in range(len(CLASSES)):
        counts[:, c] = _per_text(code == c, offsets)
    size = np.maximum(np.diff(offsets), 1)
    words = np.diff(first)
    share = counts / size[:, None]
    length = ends - starts
    upper = np.zeros(len(data) + 1, np.int32)
    np.cumsum(code == CLASSES.index("upper"), dtype=np.int32, out=upper[1:])
    flags = [length >= 12, length <= 2, (upper[ends] - upper[starts]) >= 2]
    per_word = np.maximum(words, 1)
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(np.diff(offsets)), np.log1p(words), (np.add.reduce(counts, axis=1) - counts[:, 3] - counts[:, 4]) / per_word
    for i, name in enumerate(("upper", "digit", "newline", "stop", "mark", "symbol", "high")):
        out[:, 3 + i] = share[:, CLASSES.index(name)]
    out[:, 14] = words / np.maximum(np.diff(line_first), 1)
    for i, flag in enumerate(flags):
        out[:, 15 + i] = _per_text(flag, first) / per_word
    for d in range(n):
        own = hashes[first[d] : first[d + 1]]
        if not len(own):
            continue
        _, times = np.unique(own, return_counts=True)
        out[d, 10], out[d, 11] = len(times) / len(own), times.max() / len(own)
        if len(own) >= 3:
            grams = tc.shingles(own, 3)
            out[d, 12] = 1 - len(np.unique(grams)) / len(grams)
        row = lines[line_first[d] : line_first[d + 1]]
        out[d, 13] = 1 - len(np.unique(row)) / max(len(row), 1)
    return out


@dataclass
class AdditiveModel:
    """score = sigmoid(base + sum of tables[f][bin] + sum of grids[pair][bin, bin])."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for (f, g), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[np.searchsorted(self.pair_edges[f], x[:, f], "right"), np.searchsorted(self.pair_edges[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, reg: float) -> np.ndarray:
    """Values per bin of a tree with a few leaves, grown by best gain on one feature's histogram."""
    g, h = np.r_[0, np.cumsum(grad)], np.r_[0, np.cumsum(hess)]
    worth = lambda lo, hi: (g[hi] - g[lo]) ** 2 / (h[hi] - h[lo] + reg)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for i, (lo, hi) in enumerate(parts):
            cuts = np.arange(lo + 1, hi)
            if len(cuts):
                gain = worth(lo, cuts) + worth(cuts, hi) - worth(lo, hi)
                j = int(np.argmax(gain))
                best = max(best, (float(gain[j]), i, int(cuts[j])), key=lambda b: b[0])
        if best[1] is None:
            break
        lo, hi = parts.pop(best[1])
        parts += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(grad))
    for lo, hi in parts:
        out[lo:hi] = (g[hi] - g[lo]) / (h[hi] - h[lo] + reg)
    return out


def _square(grad: np.ndarray, hess: np.ndarray, reg: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on either feature of a pair's histogram."""
    g = np.pad(grad.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h = np.pad(hess.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    worth = lambda a, b: a**2 / (b + reg)
    gi, hi = g[1:-1, 1:-1], h[1:-1, 1:-1]
    right_g, low_g = g[1:-1, -1:], g[-1:, 1:-1]
    right_h, low_h = h[1:-1, -1:], h[-1:, 1:-1]
    quads = ((gi, hi), (right_g - gi, right_h - hi), (low_g - gi, low_h - hi), (g[-1, -1] - right_g - low_g + gi, h[-1, -1] - right_h - low_h + hi))
    gain = sum(worth(a, b) for a, b in quads)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(grad)
    for (a, b), rows, cols in zip(quads, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None)) * 2, strict=True):
        out[rows, cols] = a[i, j] / (b[i, j] + reg)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, bins: int = 48, pair_bins: int = 12, rate: float = 0.12, leaves: int = 3, reg: float = 4.0) -> AdditiveModel:
    """Boost all features in turn, then the pairs with the largest gain on what is left."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(mean / (1 - mean))))
    if len(np.unique(y)) < 2:
        return model
    quant = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
    model.edges = [quant(x[:, f], bins) for f in range(x.shape[1])]
    codes = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, code in enumerate(codes):
            grad, hess = slopes()
            k = len(model.tables[f])
            step = rate * _tree(np.bincount(code, grad, k), np.bincount(code, hess, k), leaves, reg)
            model.tables[f] += step
            total += step[code]
    model.pair_edges = [quant(x[:, f], pair_bins) for f in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.pair_edges)]
    shape = [len(e) + 1 for e in model.pair_edges]

    def square(f: int, g: int) -> tuple[float, np.ndarray]:
        grad, hess = slopes()
        flat, n = coarse[f] * shape[g] + coarse[g], shape[f] * shape[g]
        return _square(np.bincount(flat, grad, n).reshape(shape[f], -1), np.bincount(flat, hess, n).reshape(shape[f], -1), reg)

    rank = sorted(((square(f, g)[0], f, g) for f in range(len(shape)) for g in range(f) if shape[f] > 1 and shape[g] > 1), reverse=True)
    model.pairs = [(f, g) for _, f, g in rank[:n_pairs]]
    model.grids = [np.zeros((shape[f], shape[g])) for f, g in model.pairs]
    for _ in range(pair_rounds):
        for i, (f, g) in enumerate(model.pairs):
            step = rate * square(f, g)[1]
            model.grids[i] += step
            total += step[coarse[f], coarse[g]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0, max_rows: int = 12_000) -> AdditiveModel:
    """Fit on at most max_rows labelled documents outside the held-out fold."""
    sample = labelled_sample(labels, label, modulus, held, max_rows)

    def rows(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    table = texts.select("doc_id", "y", "text").mapInArrow(lean(rows), "doc_id bigint, y int, x array<double>").toPandas()
    if not len(table):
        return AdditiveModel(0.0)
    x = np.stack(table["x"].to_list())
    order = np.lexsort((*x.T, table["doc_id"].to_numpy()))  # rows arrive in any order; the model must not depend on it
    return fit(x[order], table["y"].to_numpy()[order].astype(float))


def score(docs: DataFrame, model: AdditiveModel, modulus: int = 5, held: int = 0, threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row (and the columns named in keep)."""
    bound_batches(docs.sparkSession)
    kept = [F.col(c).alias(f"kept_{c}") for c in keep]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), modulus) == held).alias("held_out"), F.col("text").cast("string").alias("text"), *kept)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                s = model.score(features(part.column("text")))
                others = [part.column(f"kept_{c}") for c in keep]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), *others], names=["doc_id", "held_out", "score", *(f"kept_{c}" for c in keep)])

    types = dict(rows.dtypes)
    scored = rows.mapInArrow(lean(run), ", ".join(["doc_id bigint, held_out boolean, score double", *(f"`kept_{c}` {types[f'kept_{c}']}" for c in keep)]))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.col(f"kept_{c}").alias(c) for c in keep))
