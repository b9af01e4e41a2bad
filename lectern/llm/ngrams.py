"""Language-model scoring by deleted interpolation of trigram, bigram, unigram and uniform estimates.

P(w | u v) = l3 c(uvw) / c(uv) + l2 c(vw) / c(v) + l1 c(w) / N + l0 / (V + 1). The weights stand by bucket: powers of two of
c(uv) where the context was seen, of c(v) elsewhere. They are learned by expectation-maximisation on held-out counts: the
tokens of one training fold (`tune`) against estimates from the other training folds alone. Scores then use the counts of
all training folds.

Counting is exact, over all training texts, and grows with them; nothing corpus-sized is broadcast or sent to the driver:
1. `pack` writes texts as compressed blocks of a few megabytes, those of the tuning fold apart.
2. Each block sends its distinct n-grams (sorted hashes, delta-coded) and their training counts, cut by hash range.
3. One task for each range sums counts of equal n-grams, with and without the tuning fold, and answers every block in the
   order it asked.
4. A block joined with its answers has all counts its texts need; it is scored without further exchange.
The driver gets N, V and a histogram of estimates quantised to half octaves, on which the weights are learned; its size
is bounded by the levels, not by the corpus.
Unigrams keep 64 bits of hash; longer n-grams keep 16 bits more than the corpus's size in words takes, 44 at least, so that
one in some ten thousand shares its count with another at any size.
Defined results: null and empty texts have one token, the end; without training texts all counts are 0; repeated rows
give repeated results; other columns are ignored; a text longer than a block is a block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textcore as tc
from lectern.llm.common import bound_batches, fold, give_back, lean, materialize, size_of, slices

BLOCK_BYTES = 4 << 20
RANGE_TOKENS = 2_000_000
END = np.uint64(0x5DEECE66D1234567)
#: Buckets of a context's frequency: of the last word's, then of the last two words'.
BUCKETS = 40
#: Half octaves of an estimate, from 1 down; 0 stands for an estimate of 0.
LEVELS = 64
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("fold", pa.int32()), ("text", pa.string())])


def _planes(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    wide = values.astype(np.uint64)
    return pa.compress(np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _unplanes(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(pa.decompress(data, n * 8, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()


def pack(docs: DataFrame, modulus: int, tune: int, block_bytes: int) -> DataFrame:
    """(block, tune, data): texts in compressed blocks; the fold `tune`, on which weights are learned, stands apart."""

    def run(batches):
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                flag = np.asarray(part.column("fold")) == tune
                for tuned in (True, False):
                    own = part.filter(pa.array(flag == tuned))
                    if own.num_rows:
                        sink = pa.BufferOutputStream()
                        with pa.ipc.new_stream(sink, _SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                            out.write_batch(pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("fold").cast(pa.int32()), own.column("text").cast(pa.string())], schema=_SCHEMA))
                        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([tuned]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "tune", "data"])
                        number += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id"), modulus).cast("int").alias("fold"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "block bigint, tune boolean, data binary")


class _Block:
    """Token sequence of a block: every text's words and its end; before a text stand ends.

    grams: sorted distinct hashes of n-grams of 1, 2 and 3 tokens and, for each token, the place of the one that ends there.
    """

    def __init__(self, data: bytes, bits: int) -> None:
        table = pa.ipc.open_stream(data).read_all().combine_chunks()
        self.ids, self.fold = table.column("doc_id"), np.asarray(table.column("fold"))
        hashes, first = tc.tokenize(table.column("text"), tc.SPACE)
        token = np.insert(hashes, first[1:], END)
        self.border = first + np.arange(len(first))
        self.starts = self.border[:-1]
        before = np.r_[END, token[:-1]] if len(token) else token
        with np.errstate(over="ignore"):
            pair = tc.mix(tc.mix(before) * np.uint64(0x9E3779B97F4A7C15) + token)
            # the pair before a text's first token is two ends
            last = np.r_[np.uint64(0), pair[:-1]] if len(pair) else pair
            last[self.starts] = END
            triple = tc.mix(last * np.uint64(0xD1342543DE82EF95) + token)
        self.grams = [np.unique(x, return_inverse=True) for x in (token, pair >> np.uint64(64 - bits), triple >> np.uint64(64 - bits))]
        self.grams = [(keys, at.astype(np.int32)) for keys, at in self.grams]
        self.end = int(np.searchsorted(self.grams[0][0], END))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(values) else np.zeros(0, values.dtype)

    def estimates(self, counts: list[np.ndarray], n: int):
        """c(w), the bucket of each token, and the maximum-likelihood estimates of 3, 2 and 1 tokens."""
        c = [x[at] for x, (_, at) in zip(counts, self.grams, strict=True)]
        if not len(c[0]):
            return c[0], c[0], [c[0].astype(float)] * 3
        ends = counts[0][self.end]
        context1, context2 = np.r_[ends, c[0][:-1]], np.r_[ends, c[1][:-1]]
        context2[self.starts] = ends
        level = lambda x: np.minimum(np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) + 1, BUCKETS - 1)
        bucket = np.where(context2 > 0, BUCKETS + level(context2), np.where(context1 > 0, level(context1), 0))
        return c[0], bucket, [c[2] / np.maximum(context2, 1), c[1] / np.maximum(context1, 1), c[0] / max(n, 1)]


def _range_of(keys: np.ndarray, width: int, bits: int) -> np.ndarray:
    return (keys >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def requests(packed: DataFrame, held: int, cut: int, bits: int) -> DataFrame:
    """(kind, part, block, tune, n, keys, counts): distinct n-grams of each block and their counts in training texts.

    cut: bits of hash that make a range; bits: those that n-grams of two words and more keep."""

    def run(batches):
        for batch in batches:
            for number, tuned, data in zip(batch.column("block").to_pylist(), batch.column("tune").to_pylist(), batch.column("data"), strict=True):
                b = _Block(data.as_py(), bits)
                trained = np.repeat(b.fold != held, np.diff(b.border))
                rows = []
                for kind, (keys, at) in enumerate(b.grams):
                    counts = np.bincount(at[trained], minlength=len(keys))
                    edge = np.searchsorted(_range_of(keys, bits if kind else 64, cut), np.arange((1 << cut) + 1))
                    for p, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                        if hi > lo:
                            rows.append((kind, p, number, tuned, hi - lo, _planes(np.r_[keys[lo], np.diff(keys[lo:hi])]), _planes(counts[lo:hi])))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary())
                cols = zip(*rows, strict=True) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "part", "block", "tune", "n", "keys", "counts"])

    return packed.mapInArrow(lean(run), "kind int, part int, block bigint, tune boolean, n int, keys binary, counts binary")


def answer(table: pa.Table) -> pa.Table:
    """Counts over all blocks for each block's n-grams of one range; blocks of the tuning fold also get the counts without
    that fold. One more row has the totals of unigrams, with and without it."""
    n = table.column("n").to_pylist()
    tune = np.repeat(np.asarray(table.column("tune").combine_chunks()), n)
    flat = np.concatenate([np.cumsum(_unplanes(k.as_py(), m), dtype=np.uint64) for k, m in zip(table.column("keys"), n, strict=True)])
    counts = np.concatenate([_unplanes(c.as_py(), m) for c, m in zip(table.column("counts"), n, strict=True)]).astype(np.int64)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    size = np.diff(np.r_[first, len(flat)])
    del flat
    totals, out = [], []
    for given in (counts, np.where(tune, 0, counts)):
        totals.append(np.add.reduceat(given[order], first))
        found = np.empty(len(order), np.int64)
        found[order] = np.repeat(totals[-1], size)
        out.append(found)
    cut = np.cumsum([0, *n])
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    rows = [(b, kind, part, m, _planes(out[0][lo:hi]), _planes(out[1][lo:hi]) if t else b"", 0, 0, 0, 0) for b, t, m, lo, hi in zip(table.column("block").to_pylist(), table.column("tune").to_pylist(), n, cut[:-1], cut[1:], strict=True)]
    if kind == 0:
        rows.append((-1, kind, part, 0, b"", b"", int(totals[0].sum()), int((totals[0] > 0).sum()), int(totals[1].sum()), int((totals[1] > 0).sum())))
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4)
    names = ["block", "kind", "part", "n", "counts", "apart", "tokens", "types", "tokens_apart", "types_apart"]
    made = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    del out, order, counts, found, rows
    give_back()
    return made


ANSWER = "block bigint, kind int, part int, n int, counts binary, apart binary, tokens bigint, types bigint, tokens_apart bigint, types_apart bigint"


def _counted(packed: DataFrame, answers: DataFrame, column: str) -> DataFrame:
    """Blocks with their answers."""
    got = answers.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("kind", "part", "n", F.col(column).alias("counts"))).alias("answers"))
    return packed.join(got, "block").select("data", "answers")


def _counts(answers: list[dict]) -> list[np.ndarray]:
    """Counts of a block's distinct n-grams of 1, 2 and 3 tokens, in their order."""
    by = [[_unplanes(a["counts"], a["n"]) for a in sorted((x for x in answers if x["kind"] == k), key=lambda x: x["part"])] for k in range(3)]
    return [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in by]


def _levels(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, 1 + np.clip(np.round(-2 * np.log2(np.where(p > 0, p, 1))), 0, LEVELS - 2), 0).astype(np.int64)


def histogram_keys(bucket: np.ndarray, estimates: list[np.ndarray]) -> np.ndarray:
    """Bucket and levels of the three estimates as one number."""
    key = bucket
    for p in estimates:
        key = key * LEVELS + _levels(p)
    return key


def learn(key: np.ndarray, times: np.ndarray, types: int, rounds: int = 60) -> np.ndarray:
    """Weights (l3, l2, l1, l0) of each bucket by EM on the histogram of held-out estimates.

    A bucket without held-out tokens takes the weights of the one before. A millionth part stays with the uniform estimate,
    so that a word never seen keeps a probability above 0."""
    out = np.zeros((2 * BUCKETS, 4))
    levels, rest = [], key
    for _ in range(3):
        rest, level = np.divmod(rest, LEVELS)
        levels.append(np.where(level > 0, 2.0 ** (-(level - 1) / 2), 0.0))
    p = np.stack([*levels[::-1], np.full(len(key), 1 / (types + 1))], axis=1)
    last = np.array([0.0, 0.0, 0.9, 0.1])
    for b in range(2 * BUCKETS):
        own = rest == b
        if own.any():
            w = np.full(4, 1 / 4)
            for _ in range(rounds):
                r = p[own] * w
                w = ((r / r.sum(axis=1, keepdims=True)) * times[own, None]).sum(axis=0)
                w /= w.sum()
            last = w * (1 - 1e-6) + np.array([0, 0, 0, 1e-6])
        out[b] = last
    return out


def score(docs: DataFrame, modulus: int = 5, held: int = 1, tune: int = 2, block_bytes: int = BLOCK_BYTES, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    bound_batches(docs.sparkSession)
    _, total_bytes = size_of(docs)
    # a word takes six bytes or so
    words = max(1, total_bytes / 6)
    cut = max(0, int(np.ceil(np.log2(max(1, words / range_tokens)))))
    bits = int(np.clip(np.ceil(np.log2(words)) + 16, 44, 62))
    packed = materialize(pack(docs, modulus, tune, block_bytes), "blocks", blobs=True)
    asked = requests(packed, held, cut, bits)
    answers = materialize(asked.groupBy("kind", "part").applyInArrow(answer, ANSWER), "counts", blobs=True)
    names = ("tokens", "types", "tokens_apart", "types_apart")
    totals = answers.filter("block < 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first()
    n, v, n_apart, v_apart = (int(totals[c]) for c in names)

    def histogram(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.slice(row, 1).to_pylist()[0]
                _, bucket, estimates = _Block(own["data"], bits).estimates(_counts(own["answers"]), n_apart)
                keys, times = np.unique(histogram_keys(bucket, estimates), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], names=["key", "times"])

    tuned = _counted(packed.filter("tune"), answers, "apart").mapInArrow(lean(histogram), "key bigint, times bigint")
    found = tuned.groupBy("key").agg(F.sum("times").alias("times")).toArrow().sort_by("key")
    weights = learn(found.column("key").to_numpy(), found.column("times").to_numpy().astype(float), v_apart)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.slice(row, 1).to_pylist()[0]
                block = _Block(own["data"], bits)
                c, bucket, estimates = block.estimates(_counts(own["answers"]), n)
                base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
                w = weights[bucket]
                full = w[:, 3] / (v + 1)
                for k, p in enumerate(estimates):
                    full += w[:, k] * p
                full = np.log10(full)
                cols = [block.ids, pa.array(block.fold == held), pa.array(np.diff(block.border)), pa.array(block.per_text((c > 0).astype(np.int64))), pa.array(np.full(len(block.fold), n, np.int64)), pa.array(block.per_text(base)), pa.array(block.per_text(full))]
                cols = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in cols]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _counted(packed, answers, "counts").mapInArrow(lean(run), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
