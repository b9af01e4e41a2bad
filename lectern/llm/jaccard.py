"""N-gram Jaccard join with a token-group matrix.

1. Texts become sets of shingle hashes; equal sets are joined into one with a multiplicity.
2. Sets with the same pair of minhashes form groups of bounded size; other sets are groups of one. A group stores its
   members and the union of their tokens (a row of the token-group matrix).
3. A prefix of each set in one global token order (rarest first by a count sketch over all documents) is posted for its
   group; two groups meet only if they share a posted token and their sizes and places allow a link (prefix and position
   filter, which lose no link).
4. Groups that meet are dealt to cells of bounded size, groups that meet the same ones to the same cell; each set goes once to
   each cell of its group. There a set is compared with a group's members only if its overlap with the group's union allows a
   link, and members are then compared exactly.

Scale: texts are never shuffled whole; sets of groups that meet nobody never move. The sketch (`SKETCH` counters) and the
Bloom filter (`max_bits`) have fixed sizes; both only save work, every result is exact. Copies collapse in a two-phase
aggregate; near copies meet as blocks of groups, so their pairs are counted inside cells and never emitted: a cell gives an
edge and a count for each of its documents at most.
Defined results: null and empty texts have no shingles and link with nothing; a null id has n_shingles but no component
and no links; rows that share an id are one node; repeated rows and ties give the same class; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textcore as tc
from lectern.llm.common import SMALL_ROWS, bound_batches, give_back, lean, materialize, slices, small
from lectern.llm.graph import components

SLICE = 1 << 20
SKETCH = 1 << 20
_CHUNKS = 16
#: Groups of at most so many members are compared by their members' parity bits before any token moves.
FEW = 8
#: Bytes of tokens that a cell of groups is meant to hold.
ROOM = 1 << 22
_SALT = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def fold_vector(df: DataFrame, add, size: int, dtype: str, join: str) -> np.ndarray:
    """A vector of fixed size over all rows: add(vector, batch) in each task, then numpy's ufunc `join` by chunks."""
    step = size // _CHUNKS

    def partial(batches):
        total = np.zeros(size, dtype)
        for batch in batches:
            add(total, batch)
        data = [pa.compress(total[i * step : (i + 1) * step].tobytes(), "zstd", asbytes=True) for i in range(_CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array(data, pa.binary())], names=["chunk", "data"])

    def merge(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
                part = np.frombuffer(pa.decompress(data, step * np.dtype(dtype).itemsize, "zstd", asbytes=True), dtype)
                totals[chunk] = getattr(np, join)(totals[chunk], part) if chunk in totals else part.copy()
        for chunk, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["chunk", "data"])

    schema = "chunk int, data binary"
    bound_batches(df.sparkSession)
    rows = df.mapInArrow(lean(partial), schema).repartition(_CHUNKS, "chunk").mapInArrow(lean(merge), schema).collect()
    out = np.zeros(size, dtype)
    for row in rows:
        part = np.frombuffer(pa.decompress(bytes(row["data"]), step * np.dtype(dtype).itemsize, "zstd", asbytes=True), dtype)
        out[row["chunk"] * step : (row["chunk"] + 1) * step] = part
    return out


def _sets(column, k: int):
    hashes, first = tc.tokenize(column, tc.SPACE)
    for i in range(len(first) - 1):
        yield tc.shingle_set(hashes[first[i] : first[i + 1]], k)


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Documents by token, counted in SKETCH buckets."""

    def add(total: np.ndarray, batch) -> None:
        for part in slices(batch, "text", SLICE):
            sets = [s for s in _sets(part.column("text"), k) if len(s)]
            if sets:
                total += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(total.dtype)

    return fold_vector(docs.select("text"), add, SKETCH, "int64", "add")


def need(n: int, num: int, den: int) -> int:
    """The least overlap that a set of n tokens has with any set it links with."""
    return -(-n * num // den)


def profiles(docs: DataFrame, counts: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """Per document: size, set hashes, minhashes, prefix in the global order, parity bits of the set."""
    levels = np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                cols: list[list] = [[] for _ in range(7)]
                for s in _sets(part.column("text"), k):
                    n = len(s)
                    if not n:
                        for c, v in zip(cols, (0, 0, 0, 0, 0, [], []), strict=True):
                            c.append(v)
                        continue
                    with np.errstate(over="ignore"):
                        m = [tc.mix(s ^ salt) for salt in _SALT]
                        sums = [int(x.sum().astype(np.int64)) for x in m[:2]]
                    rank = levels[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                    length = n - need(n, num, den) + 1
                    order = np.lexsort((s, rank))[:length]
                    parity = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=512) & 1
                    bits = np.packbits(parity.astype(np.uint8)).view(np.int64)
                    low = [int(x.min().astype(np.int64)) for x in m[1:]]
                    for c, v in zip(cols, (n, *sums, *low, s[order].astype(np.int64), bits), strict=True):
                        c.append(v)
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n", "s0", "s1", "m0", "m1", "prefix", "bits"])

    return docs.mapInArrow(lean(run), "doc_id bigint, n bigint, s0 bigint, s1 bigint, m0 bigint, m1 bigint, prefix array<bigint>, bits array<bigint>")


def _groups(sets: DataFrame, members: int, tokens: int) -> DataFrame:
    """Adds gid: sets with equal minhashes, in slots of about `members` sets and `tokens` tokens."""
    slots = F.greatest(F.ceil(F.count(F.lit(1)) / members), F.ceil(F.sum("n") / tokens)).cast("long")
    wide = sets.groupBy("m0", "m1").agg(slots.alias("slots")).filter("slots > 1").select(F.col("m0").alias("w0"), F.col("m1").alias("w1"), "slots")
    joined = sets.join(small(wide), (F.col("m0") == F.col("w0")) & (F.col("m1") == F.col("w1")), "left")
    slot = F.pmod(F.xxhash64("rep"), F.coalesce("slots", F.lit(1).cast("long")))
    return joined.withColumn("gid", F.xxhash64("m0", "m1", slot)).drop("w0", "w1", "slots", "m0", "m1")


def meetings(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(g1, g2), g1 <= g2: groups that share a posted token and may hold a link."""
    post = sets.select("gid", "n", F.posexplode("prefix").alias("pos", "token")).repartition("token")
    # rest: the most tokens that a member can still share from this one on
    post = post.groupBy("token", "gid").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    a, b = (post.select("token", *(F.col(c).alias(f"{c}{i}") for c in ("gid", "lo", "hi", "rest"))) for i in (1, 2))
    fits = (F.col("gid1") < F.col("gid2")) & (F.col("hi1") * den >= F.col("lo2") * num) & (F.col("hi2") * den >= F.col("lo1") * num)
    # overlap >= num / den * (n1 + n2 - overlap)
    fits &= F.least("rest1", "rest2") * (den + num) >= (F.col("lo1") + F.col("lo2")) * num
    pairs = materialize(a.join(b, "token").filter(fits).select(F.col("gid1").alias("g1"), F.col("gid2").alias("g2")).distinct(), "pairs")
    used = pairs.select(F.col("g1").alias("gid")).union(pairs.select(F.col("g2").alias("gid"))).distinct()
    size = sets.groupBy("gid").agg(F.count(F.lit(1)).alias("c"))
    few = sets.join(used, "gid", "left_semi").join(size.filter(F.col("c") <= FEW).select("gid"), "gid", "left_semi")
    few = few.groupBy("gid").agg(F.collect_list(F.struct("n", "bits")).alias("m"))
    # parity bits of two sets differ in at most as many places as the sets differ in tokens
    apart = lambda x, y: sum((F.bit_count(F.get(x["bits"], i).bitwiseXOR(F.get(y["bits"], i))) for i in range(8)), F.lit(0))
    near = lambda x, y: apart(x, y) * (den + num) <= (x["n"] + y["n"]) * (den - num)
    may = F.exists("m1", lambda x: F.exists("m2", lambda y: near(x, y)))
    one = lambda i: few.select(F.col("gid").alias(f"g{i}"), F.col("m").alias(f"m{i}"))
    pairs = pairs.join(one(1), "g1", "left").join(one(2), "g2", "left").filter(F.col("m1").isNull() | F.col("m2").isNull() | may).select("g1", "g2")
    own = size.filter("c > 1").select(F.col("gid").alias("g1"), F.col("gid").alias("g2"))
    return pairs.union(own)


def cells(sets: DataFrame, pairs: DataFrame, room: int) -> DataFrame:
    """(cell, g1, g2): pairs of groups in cells that hold about `room` bytes of tokens, or twice that.

    A pair belongs to the smallest group that one of its two meets, so that a cluster's pairs mostly lie together. What
    belongs to one group and is larger than a cell is dealt in slots, a cell for each two slots; what is smaller shares one."""
    ends = pairs.union(pairs.select("g2", "g1")).groupBy("g1").agg(F.least("g1", F.min("g2")).alias("low"))
    low = lambda i: ends.select(F.col("g1").alias(f"g{i}"), F.col("low").alias(f"low{i}"))
    keyed = materialize(pairs.join(low(1), "g1").join(low(2), "g2").select("g1", "g2", F.least("low1", "low2").alias("key")), "keyed")
    held = keyed.select("key", F.col("g1").alias("gid")).union(keyed.select("key", F.col("g2").alias("gid"))).distinct()
    keys = held.join(sets.groupBy("gid").agg((F.sum("n") * 8).alias("bytes")), "gid").groupBy("key").agg(F.sum("bytes").alias("bytes"))
    keys = materialize(keys.select("key", "bytes", F.ceil(F.col("bytes") / room).alias("slots")), "keys")
    shared = keys.filter("slots <= 1").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()["bytes"]
    slot = lambda g: F.pmod(F.xxhash64(g), "slots")
    apart = F.xxhash64("key", F.least(slot("g1"), slot("g2")), F.greatest(slot("g1"), slot("g2")))
    cell = F.when(F.col("slots") <= 1, F.pmod(F.xxhash64("key"), F.lit(shared // room + 1))).otherwise(apart)
    return keyed.join(keys, "key").select(cell.alias("cell"), "g1", "g2")


def contents(docs: DataFrame, sets: DataFrame, dealt: DataFrame, k: int, max_bits: int) -> DataFrame:
    """(cell, gid, rep, mult, tokens): the members of the groups of each cell."""
    used = dealt.select("cell", F.col("g1").alias("gid")).union(dealt.select("cell", F.col("g2").alias("gid"))).distinct()
    wanted = materialize(sets.select("gid", "rep", "mult", "s0").join(used, "gid"), "wanted")
    bits = 1 << 16
    count = wanted.count()
    while bits < min(max_bits, 16 * count):
        bits *= 2

    def spots(ids: np.ndarray) -> np.ndarray:
        return (tc.mix(ids.astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)

    def mark(total: np.ndarray, batch) -> None:
        at = spots(batch.column("rep").to_numpy(zero_copy_only=False))
        np.bitwise_or.at(total, at >> 3, (1 << (at & 7)).astype(np.uint8))

    bloom = fold_vector(wanted.select("rep"), mark, bits // 8, "uint8", "bitwise_or")

    def tokens(batches):
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column("doc_id")))
            at = spots(batch.column("doc_id").to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array((bloom[at >> 3] >> (at & 7)) & 1 == 1))
            for part in slices(batch, "text", SLICE):
                own, sums = [], []
                for s in _sets(part.column("text"), k):
                    own.append(s.tobytes())
                    with np.errstate(over="ignore"):
                        sums.append(int(tc.mix(s ^ _SALT[0]).sum().astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sums, pa.int64()), pa.array(own, pa.binary())], names=["doc_id", "h0", "tokens"])

    sets_ = docs.mapInArrow(lean(tokens), "doc_id bigint, h0 bigint, tokens binary")
    few = F.broadcast(wanted) if count <= SMALL_ROWS else wanted
    full = sets_.join(few, (F.col("doc_id") == F.col("rep")) & (F.col("h0") == F.col("s0")))
    return full.select("cell", "gid", "rep", "mult", "tokens")


def token_matrix(sets: list[np.ndarray]) -> tuple[np.ndarray, bytes]:
    """The union of a group's tokens and, for more than one member, a compressed bit matrix of members by tokens."""
    if len(sets) == 1:
        return sets[0], b""
    union = np.unique(np.concatenate(sets))
    bits = np.zeros((len(sets), len(union)), np.uint8)
    for i, s in enumerate(sets):
        bits[i, np.searchsorted(union, s)] = 1
    return union, pa.compress(np.packbits(bits, axis=1).tobytes(), "zstd", asbytes=True)


def _unpack(members: int, tokens: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    union = np.frombuffer(tokens, np.uint64)
    if members == 1:
        return union, np.ones((1, len(union)), np.uint8)
    width = -(-len(union) // 8)
    packed = np.frombuffer(pa.decompress(matrix, members * width, "zstd", asbytes=True), np.uint8).reshape(members, width)
    return union, np.unpackbits(packed, axis=1, count=len(union))


def overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], num: int, den: int) -> np.ndarray:
    """True where members a[i] and b[j] link. A set whose overlap with b's union is too small opens no comparison."""
    (union_a, bits_a), (union_b, bits_b) = a, b
    links = np.zeros((len(bits_a), len(bits_b)), bool)
    at = np.minimum(np.searchsorted(union_b, union_a), len(union_b) - 1)
    shared = union_b[at] == union_a
    inside = bits_a[:, shared]
    size_a, size_b = bits_a.sum(axis=1, dtype=np.int64), bits_b.sum(axis=1, dtype=np.int64)
    open_ = np.flatnonzero(inside.sum(axis=1, dtype=np.int64) * den >= size_a * num)
    if len(open_):
        common = (inside[open_].astype(np.float32) @ bits_b[:, at[shared]].astype(np.float32).T).astype(np.int64)
        links[open_] = den * common >= num * (size_a[open_, None] + size_b[None] - common)
    return links


def stars(links: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges from each node to the smallest of its component in a matrix of links: as many as nodes at most.

    Rows and columns are the same nodes, or columns are further nodes numbered after the rows.
    """
    if not links.any():
        return []
    n, m = links.shape
    left, right = np.arange(n), np.arange(m) if same else n + np.arange(m)
    none = n + m
    while True:
        new = np.minimum(left, np.where(links, right[None], none).min(axis=1))
        far = np.minimum(right, np.where(links, new[:, None], none).min(axis=0))
        if same:
            new = far = np.minimum(new, far)
        if (new == left).all() and (far == right).all():
            break
        left, right = new, far
    label = left if same else np.r_[left, right]
    return [(int(i), int(label[i])) for i in np.flatnonzero(label != np.arange(len(label)))]


def _classes(group: tuple[np.ndarray, np.ndarray], num: int, den: int) -> np.ndarray:
    """For each member the first member that it is connected with inside its group."""
    n = len(group[1])
    first = np.arange(n)
    for i, j in stars(overlaps(group, group, num, den), True) if n > 1 else ():
        first[i] = j
    return first


def _open(row: dict, num: int, den: int, counted: bool = True) -> tuple[list, list]:
    """Connecting edges and link counts of two groups that meet (or of one group).

    What one group connects is told by its own row: between two groups only their classes are connected, mostly by one
    edge, so that the edges of a large cluster do not grow with the square of its members."""
    same = row["reps2"] is None
    a = _unpack(len(row["reps1"]), row["tokens1"], row["matrix1"])
    b = a if same else _unpack(len(row["reps2"]), row["tokens2"], row["matrix2"])
    links = overlaps(a, b, num, den)
    nodes = row["reps1"] + ([] if same else row["reps2"])
    if same:
        np.fill_diagonal(links, False)
        edges = stars(links, True)
    elif links.any():
        (ra, ca), (rb, cb) = (np.unique(_classes(g, num, den), return_inverse=True) for g in (a, b))
        between = np.zeros((len(ra), len(rb)), bool)
        i, j = np.nonzero(links)
        between[ca[i], cb[j]] = True
        at = np.r_[ra, len(row["reps1"]) + rb]
        edges = [(at[x], at[y]) for x, y in stars(between, False)]
    else:
        edges = []
    counts = np.zeros(0, np.int64)
    if counted:
        mult_a, mult_b = np.array(row["mults1"]), np.array(row["mults1" if same else "mults2"])
        counts = np.r_[links @ mult_b, [] if same else mult_a @ links].astype(np.int64)
    return [(nodes[i], nodes[j]) for i, j in edges], [(n, c) for n, c in zip(nodes, counts.tolist(), strict=counted) if c]


def _compare(members: pa.Table, pairs: pa.Table, num: int, den: int, counted: bool) -> pa.Table:
    """Connecting edges and link counts of a cell: at most one of each for a document."""
    found: dict[int, dict] = {}
    for gid, rep, mult, tokens in zip(*(members.column(c).to_pylist() for c in ("gid", "rep", "mult", "tokens")), strict=True):
        found.setdefault(gid, {})[rep, tokens] = mult
    groups = {}
    for gid, own in found.items():
        order = sorted(own)
        union, matrix = token_matrix([np.frombuffer(tokens, np.uint64) for _, tokens in order])
        groups[gid] = {"reps": [rep for rep, _ in order], "mults": [own[x] for x in order], "tokens": union.tobytes(), "matrix": matrix}
    parent: dict[int, int] = {}
    totals: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for g1, g2 in zip(pairs.column("g1").to_pylist(), pairs.column("g2").to_pylist(), strict=True):
        if g1 not in groups or g2 not in groups:
            continue
        second = dict.fromkeys(groups[g2]) if g1 == g2 else groups[g2]
        edges, counts = _open({f"{c}1": v for c, v in groups[g1].items()} | {f"{c}2": v for c, v in second.items()}, num, den, counted)
        for x, y in edges:
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
        for node, n in counts:
            totals[node] = totals.get(node, 0) + n
    edges = [(x, root(x)) for x in parent if root(x) != x]
    cols = ([x for x, _ in edges] + list(totals), [y for _, y in edges] + [None] * len(totals), [0] * len(edges) + list(totals.values()))
    give_back()
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "links"])


def similarity_join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, members: int = 48, group_tokens: int = 1 << 16, max_bits: int = 1 << 27, counted: bool = True, room: int = ROOM) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row: documents link when den * intersection >= num * union.

    counted: whether links are counted; else n_links is left out, and every link still joins its documents' components."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(profiles(docs, sketch(docs, k), k, num, den), "profiles")
    real = rows.filter("n > 0 and doc_id is not null")
    first = lambda c: F.first(c).alias(c)
    same = ["n", "s0", "s1"]
    # distinct ids are counted apart: in one aggregate they would send prefixes and bits twice
    copies = real.select(*same, "doc_id").distinct().groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    sets = real.groupBy(*same).agg(*map(first, ("m0", "m1", "prefix", "bits"))).join(copies, same)
    sets = materialize(_groups(sets, members, group_tokens), "sets")
    pairs = materialize(meetings(sets, num, den), "meetings")
    dealt = materialize(cells(sets, pairs, room), "cells")

    def opened(held: pa.Table, met: pa.Table) -> pa.Table:
        return _compare(held, met, num, den, counted)

    held = contents(docs, sets, dealt, k, max_bits)
    found = materialize(held.groupBy("cell").cogroup(dealt.groupBy("cell")).applyInArrow(opened, "a bigint, b bigint, links bigint"), "links")
    classes = components(found.filter("b is not null").select("a", "b"))
    links = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    reps = sets.select("n", "s0", "s1", "rep", "mult").join(classes, F.col("rep") == F.col("node"), "left").join(links, F.col("rep") == F.col("a"), "left")
    reps = reps.select(F.col("n").alias("rn"), F.col("s0").alias("r0"), F.col("s1").alias("r1"), F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"))
    ids = rows.select("doc_id", "n", "s0", "s1")
    out = ids.join(reps, (F.col("n") == F.col("rn")) & (F.col("s0") == F.col("r0")) & (F.col("s1") == F.col("r1")) & F.col("doc_id").isNotNull(), "left")
    own = [F.coalesce("links", F.lit(0).cast("long")).alias("n_links")] if counted else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), *own)
