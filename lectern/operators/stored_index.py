"""A stored full-text index: positional trigram postings in blocks, kept up to date by deltas, searched by block bounds.

Layout. Index rows are cut into blocks of at most BLOCK_ROWS rows and BLOCK_CHARS characters. A block's row of a trigram holds
which of the block's rows have it, how often, their sizes and where it stands in them, and what bounds them: the largest
frequency and the smallest size. Each kind of number is a column of its own, as numbers of one kind compress best together and
counts need no places: `gaps` (of rows, doubled, and one more where a trigram stands there twice or more), `times` (how often
then, less two), `sizes`, `low` and `high` (the lowest eight bits of the gaps of places, and what is above them), all but `low` of
seven bits a byte, so that what is stored is a small multiple of the texts. The files lie in folders by `bucket`, a hash of the trigram, sorted by trigram; bucket -1 holds the
blocks' own rows (`docs`). Postings of few rows are rebalanced to tasks of bounded size by bucket, a large bucket to several;
those of many are written by the task that cut them, a file for each bucket. A search reads its trigrams' buckets and nothing else.

Changes. `update` writes one more segment with the rows of the touched keys, and which places of older segments died by it; a
segment is never rewritten. `compact` writes all live rows as one segment. A pointer file under the next number names the
segments, as for the library's tables; of two writers that began with the same state one fails.

Search. A term's occurrences are the places where its trigrams stand one after the other: positions, less the trigram's
offset in the term, are intersected from the rarest trigram on. The score needs in how many rows a term stands; for terms
of three characters that is in the headers, other terms are counted once for each state of the index and remembered. The
ranked search then goes through a partition's blocks by falling bound and stops when no block can reach the k-th best
score; partial results of all partitions are merged. Results equal those of `search.bm25` over the rows.
"""

from __future__ import annotations

import heapq
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.search import K1, LEAST_IDF, B
from lectern.shared import frees_shuffles
from lectern.tables import Pointers

BLOCK_ROWS = 512
BLOCK_CHARS = 2_000_000
#: Positions that one task of a search holds.
TASK_POSITIONS = 4_000_000
#: Scores are compared to nine digits.
EPS = 1e-8
DOC = "struct<kind:int,source_id:bigint,article_id:bigint,feed_id:bigint,title:string,timestamp:bigint,archived:boolean,size:int>"
POSTING = f"trigram string, block bigint, n int, held int, max_tf int, min_size int, gaps binary, times binary, sizes binary, low binary, high binary, docs array<{DOC}>"
_FIELDS = ("kind", "source_id", "article_id", "feed_id", "title", "timestamp", "archived")
_DOCS = pa.list_(pa.struct([("kind", pa.int32()), ("source_id", pa.int64()), ("article_id", pa.int64()), ("feed_id", pa.int64()), ("title", pa.string()), ("timestamp", pa.int64()), ("archived", pa.bool_()), ("size", pa.int32())]))


#: Rows of a block that one number of `dead` marks.
MARKS = 62


def _before(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... in each of groups of these sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(_before(sizes), sizes)


def _gaps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences to the one before; the first of each group as it is."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def _sums(gaps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of which `gaps` are the differences in groups of these sizes, none of them empty."""
    total = np.cumsum(gaps)
    return total - np.repeat((total - gaps)[_before(sizes)], sizes) if len(gaps) else gaps


def _pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**35 in seven bits a byte, a set eighth bit meaning that more follow; and where each begins."""
    size = 1 + sum((values >= 1 << 7 * i).astype(np.int64) for i in range(1, 5))
    begins = np.r_[0, np.cumsum(size)]
    out = np.empty(begins[-1], np.uint8)
    for i in range(5):
        own = np.flatnonzero(size > i)
        out[begins[own] + i] = values[own] >> 7 * i & 127 | (size[own] > i + 1).astype(np.int64) << 7
    return out, begins


def _unpack(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    sizes = np.diff(np.flatnonzero(data < 128), prepend=-1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * _within(sizes), _before(sizes))


def _binary(data: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(data)])


def _packed(n: np.ndarray, held: np.ndarray, row: np.ndarray, tf: np.ndarray, sizes: np.ndarray, pos: np.ndarray) -> list[pa.Array]:
    """The columns NUMBERS of trigrams with n rows and held positions each."""
    first, many = np.r_[_before(n), len(row)], tf > 1
    gaps = _gaps(pos, _before(tf))
    out = []
    for values, begins in ((_gaps(row, _before(n)) * 2 + many, first), (tf[many] - 2, np.r_[0, np.cumsum(many)][first]), (sizes, first), (None, None), (gaps >> 8, np.r_[_before(held), len(pos)])):
        if values is None:
            out.append(_binary((gaps & 255).astype(np.uint8), np.r_[_before(held), len(pos)]))
        else:
            data, at = _pack(values)
            out.append(_binary(data, at[begins]))
    return out


def _counts(table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n, held and the rows and frequencies of all posting rows of a table or batch, none without entries."""
    n, held = (np.asarray(table.column(c).to_numpy(), np.int64) for c in ("n", "held"))
    gaps = _unpack(_bytes(table.column("gaps")))
    tf = np.ones(len(gaps), np.int64)
    tf[gaps & 1 == 1] = _unpack(_bytes(table.column("times"))) + 2
    return n, held, _sums(gaps >> 1, n), tf


def _entries(table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n, held and the rows, frequencies, sizes, positions of all posting rows of a table or batch, none without entries."""
    n, held, row, tf = _counts(table)
    sizes, low, high = (_bytes(table.column(c)) for c in NUMBERS[2:])
    return n, held, row, tf, _unpack(sizes), _sums(_unpack(high) << 8 | low, tf)


def _bytes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The bytes of all values of a binary column."""
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([np.zeros(0, np.uint8), *map(_bytes, column.chunks)])
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]


def _marked(dead: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of a column of marks, where each row's begin, and how many they are (null: none)."""
    count = np.asarray(pc.fill_null(pc.list_value_length(dead), 0).to_numpy(zero_copy_only=False), np.int64)
    return np.asarray(dead.flatten().to_numpy(zero_copy_only=False), np.int64), _before(count), count


def block_postings(texts: list[str | None], docs: list[dict], block: int) -> pa.RecordBatch:
    """Rows of one block: one of its own (trigram ''), and one for each trigram in its folded texts (null: none, no size)."""
    codes = [np.frombuffer((t or "").encode("utf-32-le"), np.uint32).astype(np.int64) for t in texts]
    sizes = np.array([len(c) - 2 for c in codes], np.int64)
    long = [i for i, c in enumerate(codes) if len(c) > 2]
    none = np.zeros(0, np.int64)
    gram = np.concatenate([codes[i][:-2] << 42 | codes[i][1:-1] << 21 | codes[i][2:] for i in long] + [none])
    ord_ = np.repeat(np.array(long, np.int64), sizes[long]) if long else none
    pos = np.concatenate([np.arange(sizes[i]) for i in long] + [none])
    order = np.argsort(gram, kind="stable")
    gram, ord_, pos = gram[order], ord_[order], pos[order]
    own = [[d | {"size": None if t is None else int(s)} for d, s, t in zip(docs, sizes, texts, strict=True)]]
    head = pa.RecordBatch.from_arrays([pa.array([""]), pa.array([block]), *(pa.array([v], pa.int32()) for v in (len(docs), 0, 0, 0)), *(pa.nulls(1, pa.binary()) for _ in NUMBERS), pa.array(own, _DOCS)], names=NAMES)
    if not len(gram):
        return head
    change = np.r_[True, gram[1:] != gram[:-1]]
    begins = np.flatnonzero(change)  # of trigrams, among positions
    run = np.flatnonzero(change | np.r_[True, ord_[1:] != ord_[:-1]])  # of rows within trigrams
    first = np.searchsorted(run, begins)
    tf, row = np.diff(np.r_[run, len(gram)]), ord_[run]
    keys = gram[begins]
    letters = np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF], 1).astype(np.uint32).tobytes().decode("utf-32-le")
    names = [letters[i : i + 3] for i in range(0, len(letters), 3)]
    n, held = np.diff(np.r_[first, len(run)]), np.diff(np.r_[begins, len(gram)])
    numbers = [n, held, np.maximum.reduceat(tf, first), np.minimum.reduceat(sizes[row], first)]
    rows = pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(keys), block)), *(pa.array(v.astype(np.int32)) for v in numbers), *_packed(n, held, row, tf, sizes[row], pos), pa.nulls(len(keys), _DOCS)], names=NAMES)
    return pa.Table.from_batches([head, rows.cast(head.schema)]).combine_chunks().to_batches()[0]


NUMBERS = ["gaps", "times", "sizes", "low", "high"]
NAMES = ["trigram", "block", "n", "held", "max_tf", "min_size", *NUMBERS, "docs"]


def postings(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of index rows, cut as they come: no shuffle of texts."""

    def cut(batches):
        first, count, held = TaskContext.get().partitionId() << 32, 0, 0
        texts, docs = [], []
        for batch in batches:
            for row in batch.to_pylist():
                text = row.pop("low")
                if docs and (len(docs) == block_rows or held + len(text or "") > block_chars):
                    yield block_postings(texts, docs, first + count)
                    texts, docs, count, held = [], [], count + 1, 0
                texts.append(text)
                docs.append(row)
                held += len(text or "")
        if docs:
            yield block_postings(texts, docs, first + count)

    low = rows.select(F.col("kind").cast("int").alias("kind"), *_FIELDS[1:5], F.col("timestamp").cast("long").alias("timestamp"), "archived", F.lower("body").alias("low"))
    return low.mapInArrow(cut, POSTING)


def _grams(term: str) -> list[tuple[str, int]]:
    return [(term[i : i + 3], i) for i in range(len(term) - 2)]


class _Block:
    """A block's rows of the wanted trigrams."""

    def __init__(self) -> None:
        self.rows: dict[str, tuple] = {}
        self.dead = np.zeros(0, np.int64)

    def frequencies(self, term: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows in which the term stands, how often, and their sizes."""
        grams = sorted(((g, at) for g, at in _grams(term)), key=lambda x: len(self.rows[x[0]][3]))
        keys = None
        for gram, at in grams:
            ords, tfs, _, places = self.rows[gram]
            own = np.repeat(ords.astype(np.int64), tfs) << 32 | (places.astype(np.int64) - at) & 0xFFFFFFFF
            keys = own if keys is None else np.intersect1d(keys, own, assume_unique=True)
        rows, times = np.unique(keys >> 32, return_counts=True)
        alive = ~np.isin(rows, self.dead)
        rows, times = rows[alive], times[alive]
        ords, _, sizes, _ = self.rows[grams[0][0]]
        return rows, times, sizes[np.searchsorted(ords, rows)]


def _blocks(table: pa.Table) -> dict[tuple[int, int], _Block]:
    found: dict[tuple[int, int], _Block] = {}
    n, held, *lists, positions = _entries(table)
    first, begins = _before(n), _before(held)
    keys = zip(*(table.column(c).to_pylist() for c in ("segment", "block", "trigram", "dead")), strict=True)
    for i, (segment, block, gram, dead) in enumerate(keys):
        own = found.setdefault((segment, block), _Block())
        own.rows[gram] = (*(values[first[i] : first[i] + n[i]] for values in lists), positions[begins[i] : begins[i] + held[i]])
        own.dead = np.array([MARKS * w + b for w, marks in enumerate(dead or []) for b in range(MARKS) if marks >> b & 1], np.int64)
    return found


def _alive(batches):
    """(trigram, df, tf) of posting rows with the marks of their blocks' dead rows."""
    for batch in batches:
        n, held, row, tf = _counts(batch)
        marks, begins, count = _marked(batch.column("dead"))
        word, at = row // MARKS, np.repeat(np.arange(len(n)), n)
        known = word < count[at]
        dead = np.zeros(len(row), bool)
        dead[known] = marks[begins[at[known]] + word[known]] >> row[known] % MARKS & 1 == 1
        sums = [np.bincount(at, weights, len(n)).astype(np.int64) for weights in (~dead, np.where(dead, 0, tf))]
        yield pa.RecordBatch.from_arrays([batch.column("trigram"), *(pa.array(v, pa.int64()) for v in sums)], names=["trigram", "df", "tf"])


def _weight(idf: float, tf, size, mean: float):
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * size / mean))


def best_of(blocks: dict[tuple[int, int], _Block], queries: dict[int, list[str]], idf: dict[str, float], mean: float, limit: int) -> tuple[list[tuple], dict[int, tuple[int, int]]]:
    """(query, segment, block, ord, score) of the rows whose score reaches each query's k-th best (ties too), and for each
    query how many blocks were opened, of how many that hold all its trigrams."""
    hits, opened = [], {}
    for key, terms in queries.items():
        grams = {g for t in terms for g, _ in _grams(t)}
        bounds = []
        for at, block in blocks.items():
            if grams <= block.rows.keys():
                bound = 0.0
                for t in terms:
                    own = [block.rows[g] for g, _ in _grams(t)]
                    bound += _weight(idf[t], min(int(r[1].max()) for r in own), max(int(r[2].min()) for r in own), mean)
                bounds.append((-bound, at))
        best: list[float] = []
        found, count = [], 0
        for bound, at in sorted(bounds):
            if len(best) == limit and -bound < best[0] - EPS:
                break
            count += 1
            rows, total = None, None
            for t in terms:
                own, tf, size = blocks[at].frequencies(t)
                part = _weight(idf[t], tf.astype(float), size.astype(float), mean)
                if rows is None:
                    rows, total = own, 0.0 + part
                else:
                    both, i, j = np.intersect1d(rows, own, assume_unique=True, return_indices=True)
                    rows, total = both, total[i] + part[j]
            for row, score in zip(rows.tolist(), total.tolist(), strict=True):
                if len(best) < limit or score >= best[0] - EPS:
                    found.append((key, *at, row, score))
                    heapq.heappush(best, score)
                    if len(best) > limit:
                        heapq.heappop(best)
        opened[key] = count, len(bounds)
        hits += [h for h in found if len(best) < limit or h[-1] >= best[0] - EPS]
    return hits, opened


class StoredIndex:
    """An index under a root folder on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, block_rows: int = BLOCK_ROWS) -> None:
        self.spark, self.root, self.buckets, self.block_rows = spark, root.rstrip("/"), buckets, block_rows
        self.pointers = Pointers(spark, root)
        self._counted: dict[tuple[int, str], int] = {}

    # ---- changes

    def _bucket(self):
        return F.when(F.col("trigram") == "", -1).otherwise(F.pmod(F.xxhash64("trigram"), F.lit(self.buckets))).cast("int")

    @staticmethod
    def _totals(rows: DataFrame) -> dict[str, int]:
        """Rows, how many of them have a size, and the sum of these."""
        return rows.agg(F.count(F.lit(1)).alias("rows"), F.count("size").alias("sized"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first().asDict()

    def _write(self, rows: DataFrame, in_place: bool) -> tuple[str, dict[str, int]]:
        """A segment of rows: its folder and its totals."""
        path = f"segment-{uuid.uuid4().hex}"
        keyed = postings(rows, self.block_rows).withColumn("bucket", self._bucket())
        # a frequent trigram has a row for each block: adaptive execution deals a bucket of many rows to several tasks
        keyed = keyed if in_place else keyed.hint("rebalance", "bucket")
        with frees_shuffles(self.spark):
            keyed.sortWithinPartitions("bucket", "trigram", "block").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/{path}")
        docs = self.spark.read.schema(f"{POSTING}, bucket int").parquet(f"{self.root}/{path}").filter("bucket = -1").select(F.inline("docs"))
        return path, self._totals(docs)

    def build(self, rows: DataFrame, in_place: bool = False) -> None:
        """The index of these rows and no others, as one segment.

        in_place: postings, several times as large as the texts, are sorted and written by the task that cuts them and cross
        no shuffle. That is a file for each task and bucket: for many rows, in partitions of the size that a join leaves.
        Otherwise they are gathered by bucket in as few files as can be."""
        number, _ = self.pointers.state()
        path, own = self._write(rows, in_place)
        self.pointers.publish(number, {"segments": [path], "dead": []} | own)

    def update(self, keys: DataFrame, rows: DataFrame, narrowed: bool = False, in_place: bool = False) -> None:
        """Replaces the rows of the touched keys (kind, source_id): rows holds what they are now, keys without a row are gone.

        narrowed: rows holds no others, so their texts need not meet the keys; in_place as for `build`."""
        number, now = self.pointers.state()
        if not now:
            raise ValueError("the index has not been built")
        keys = keys.select(F.col("kind").cast("int").alias("kind"), F.col("source_id").cast("long").alias("source_id")).distinct()
        path, own = self._write(rows if narrowed else rows.join(keys, ["kind", "source_id"], "left_semi"), in_place)
        gone = f"dead-{uuid.uuid4().hex}"
        with frees_shuffles(self.spark):
            self._places(now).select("segment", "block", "ord", "size", "kind", "source_id").join(keys, ["kind", "source_id"], "left_semi").select("segment", "block", "ord", "size").write.parquet(f"{self.root}/{gone}")
        lost = self._totals(self.spark.read.parquet(f"{self.root}/{gone}"))
        self.pointers.publish(number, {"segments": [*now["segments"], path], "dead": [*now["dead"], gone]} | {k: now[k] + own[k] - lost[k] for k in own})

    def compact(self, rows: DataFrame) -> None:
        """One segment of `rows`, the library's index rows of now, in place of all; older ones go when no pointer names them."""
        old = self.pointers.folders(("segment-", "dead-"))  # what later writers begin is not among these
        self.build(rows)
        self.pointers.remove(old - {p for state in self.pointers.states() for p in (*state["segments"], *state["dead"])})

    # ---- reading

    def _state(self) -> dict:
        return self.pointers.state()[1] or {"segments": [], "dead": [], "rows": 0, "sized": 0, "size": 0}

    def _read(self, now: dict) -> DataFrame:
        parts = [self.spark.read.schema(f"{POSTING}, bucket int").parquet(f"{self.root}/{p}").withColumn("segment", F.lit(i)) for i, p in enumerate(now["segments"])]
        out = parts[0] if parts else self.spark.createDataFrame([], f"{POSTING}, bucket int, segment int")
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _dead(self, now: dict) -> DataFrame:
        """(segment, block, dead): rows that were replaced or removed, marked in numbers of MARKS bits; a block has at most BLOCK_ROWS."""
        schema = "segment int, block bigint, ord int, size int"
        if not now["dead"]:
            return self.spark.createDataFrame([], "segment int, block bigint, dead array<bigint>")
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in now["dead"]))
        marks = F.expr(f"transform(sequence(0L, array_max(own) div {MARKS}), w -> aggregate(filter(own, o -> o div {MARKS} = w), 0L, (s, o) -> s | shiftleft(1L, o % {MARKS})))")
        # a row of a few numbers for each block of up to BLOCK_ROWS rows: sent to the postings, which would else be dealt by block
        return F.broadcast(rows.groupBy("segment", "block").agg(F.collect_set("ord").alias("own")).select("segment", "block", marks.alias("dead")))

    def _places(self, now: dict) -> DataFrame:
        """Live rows of the index with their places."""
        rows = self._read(now).filter("bucket = -1").join(self._dead(now), ["segment", "block"], "left")
        rows = rows.select("segment", "block", "dead", F.posexplode("docs").alias("ord", "doc")).filter(f"coalesce(shiftright(get(dead, cast(ord div {MARKS} as int)), ord % {MARKS}) & 1L, 0L) = 0")
        return rows.select("segment", "block", "ord", "doc.*")

    def rows(self) -> DataFrame:
        """What is indexed now, without bodies."""
        return self._places(self._state()).drop("segment", "block", "ord")

    def matching(self, terms: list[str], now: dict | None = None) -> DataFrame:
        """Posting rows of the terms' trigrams: only their buckets are read."""
        now = now or self._state()
        grams = sorted({g for t in terms for g, _ in _grams(t)})
        buckets = self.spark.createDataFrame([(g,) for g in grams], "trigram string").select(self._bucket().alias("b")).distinct().collect() if grams else []
        return self._read(now).filter(F.col("bucket").isin([r["b"] for r in buckets]) & F.col("trigram").isin(grams))

    def _dealt(self, terms: list[str], now: dict) -> DataFrame:
        """Posting rows with the dead of their blocks, dealt to tasks by block."""
        found = self.matching(terms, now)
        held = found.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
        rows = found.drop("docs", "bucket", "max_tf", "min_size")
        rows = rows.join(self._dead(now), ["segment", "block"], "left") if now["dead"] else rows.withColumn("dead", F.lit(None).cast("array<bigint>"))
        return rows.withColumn("part", F.pmod(F.xxhash64("segment", "block"), F.lit(max(1, -(-held // TASK_POSITIONS)))))

    def trigram_counts(self) -> DataFrame:
        """(trigram, df, occurrences) over live rows."""
        now = self._state()
        rows = self._read(now).filter("bucket >= 0").select("segment", "block", "trigram", "n", "held", "gaps", "times")
        if now["dead"]:
            rows = rows.join(self._dead(now), ["segment", "block"], "left").select("trigram", "n", "held", "gaps", "times", "dead")
            each = rows.mapInArrow(_alive, "trigram string, df bigint, tf bigint")
        else:
            each = rows.select("trigram", F.col("n").alias("df"), F.col("held").alias("tf"))
        return each.groupBy("trigram").agg(F.sum("df").alias("df"), F.sum("tf").alias("occurrences")).filter("df > 0")

    def document_counts(self, terms: list[str]) -> dict[str, int]:
        """In how many live rows each term stands, counted once for each state of the index."""
        number, now = self.pointers.state()
        new = [t for t in terms if (number, t) not in self._counted]
        if new and now:
            short = [t for t in new if len(t) == 3 and not now["dead"]]
            for r in self.matching(short, now).groupBy("trigram").agg(F.sum("n").alias("n")).collect() if short else ():
                self._counted[number, r["trigram"]] = r["n"]
            long = [t for t in new if t not in short]

            def count(table: pa.Table) -> pa.Table:
                out = dict.fromkeys(long, 0)
                for block in _blocks(table).values():
                    for t in long:
                        if all(g in block.rows for g, _ in _grams(t)):
                            out[t] += len(block.frequencies(t)[0])
                return pa.table({"term": pa.array(list(out), pa.string()), "n": pa.array(list(out.values()), pa.int64())})

            if long:
                parts = self._dealt(long, now).groupBy("part").applyInArrow(count, "term string, n bigint")
                for r in parts.groupBy("term").agg(F.sum("n").alias("n")).collect():
                    self._counted[number, r["term"]] = r["n"]
        return {t: self._counted.get((number, t), 0) for t in terms}

    def partial(self, queries: dict[int, str], limit: int) -> DataFrame:
        """Each partition's best places (query_id, segment, block, ord, score); rows of ord -1 hold how many blocks were
        opened (score) of how many candidates (block)."""
        now = self._state()
        split = {k: list(dict.fromkeys(t.lower() for t in q.split())) for k, q in queries.items()}
        if any(len(t) < 3 for terms in split.values() for t in terms):
            raise ValueError("a ranked search needs terms of three characters or more")
        split = {k: terms for k, terms in split.items() if terms}
        terms = sorted({t for own in split.values() for t in own})
        schema = "query_id int, segment int, block bigint, ord int, score double"
        if not terms or limit <= 0 or not now["rows"]:
            return self.spark.createDataFrame([], schema)
        df, n = self.document_counts(terms), now["rows"]
        idf = {t: max(math.log((n - d + 0.5) / (d + 0.5)), 0.0) or LEAST_IDF for t, d in df.items()}
        mean = now["size"] / max(1, now["sized"]) or 1.0

        def search(table: pa.Table) -> pa.Table:
            hits, opened = best_of(_blocks(table), split, idf, mean, limit)
            hits += [(k, -1, total, -1, float(count)) for k, (count, total) in opened.items()]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64())
            return pa.table([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), kinds, strict=True)] if hits else [pa.array([], t) for t in kinds], names=["query_id", "segment", "block", "ord", "score"])

        return self._dealt(terms, now).groupBy("part").applyInArrow(search, schema)

    def search(self, queries: dict[int, str], limit: int) -> DataFrame:
        """The best `limit` rows of each query, as `search.bm25` gives them."""
        hits = self.partial(queries, limit).filter("ord >= 0")
        placed = hits.join(self._places(self._state()), ["segment", "block", "ord"]).withColumn("score", -F.col("score"))
        best = Window.partitionBy("query_id").orderBy(F.round("score", 9), F.desc("timestamp"), F.desc("article_id"), "kind", "source_id")
        ranked = placed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
        return ranked.select("query_id", "rank", "kind", "source_id", "article_id", "feed_id", "title", "timestamp", "archived", "score")


def touched(articles: DataFrame, selections: DataFrame, article_tags: DataFrame, *, article_ids: DataFrame | None = None, selection_ids: DataFrame | None = None, tag_ids: DataFrame | None = None, feed_ids: DataFrame | None = None) -> DataFrame:
    """(kind, source_id) of index rows that changes of these ids (one column `id` each) touch.

    Tables are given as they are before or after the change; after removals both calls are needed, as a row that is gone
    shows its references only before."""
    ids = lambda df: df.select(F.col("id").cast("long").alias("article_id"))
    changed = [ids(article_ids)] if article_ids is not None else []
    if tag_ids is not None:
        changed.append(article_tags.join(tag_ids.select(F.col("id").alias("tag_id")), "tag_id", "left_semi").select("article_id"))
    if feed_ids is not None:
        changed.append(ids(articles.join(feed_ids.select(F.col("id").alias("feed_id")), "feed_id", "left_semi")))
    both = lambda df, column, kinds: df.select(F.explode(F.array(*map(F.lit, kinds))).alias("kind"), F.col(column).cast("long").alias("source_id"))
    out = [both(selection_ids, "id", (2, 3))] if selection_ids is not None else []
    if changed:
        every = changed[0]
        for c in changed[1:]:
            every = every.unionByName(c)
        every = every.distinct()
        out += [both(every, "article_id", (0, 1)), both(selections.join(every, "article_id", "left_semi"), "id", (2, 3))]
    keys = out[0]
    for k in out[1:]:
        keys = keys.unionByName(k)
    return keys.distinct()
