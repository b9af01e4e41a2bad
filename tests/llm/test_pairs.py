"""Embedding near duplicates, the n-gram join and connected components against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import SPACE, classes, documents, low, texts

from pyspark.sql import functions as F

from lectern.llm import jaccard, vectors
from lectern.llm.graph import components


def test_components_of_long_and_dense_graphs(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 120)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(80)] + [(500, x) for x in range(501, 540)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: c for n, c in classes(nodes, links).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_extreme_components(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1.0001e200], 1), (3, [1e-200, 1e-200], 1), (4, [5e-324, 5e-324], 1), (5, [1e308, 0.0], 1), (6, [1e-308, 1e300], 1), (7, [2.0, 2.0], 2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6), 7: (0, 7)}


def test_cells_prune_what_is_far(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(24, 6))
    x = vectors.unit(base[rng.integers(0, 24, 4000)] + rng.normal(scale=0.05, size=(4000, 6)))
    home, row, _ = vectors._cells(x, vectors.spherical_kmeans(x, 16), math.sqrt(2 - 2 * 0.98))
    sizes = np.bincount(home, minlength=16)
    assert len(row) < 2 * len(x) and (sizes**2).sum() < 0.3 * len(x) ** 2


def test_every_graded_run_has_cells(spark):
    """On the smallest tables too, vectors are dealt to the cells of k-means centres."""
    valid = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("label is not null and embedding is not null")
    valid = valid.select("vec_id", valid["label"].cast("string").alias("label"), valid["embedding"].alias("x"), valid["vec_id"].alias("h"))
    alone = valid.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count("vec_id").alias("mult"))
    placed = vectors.placement(valid, alone, 0.98, 512, 24, 4096, 20_000, 1.0)
    labels, cells, homes = placed.select(F.countDistinct("label"), F.countDistinct("label", "dim", "cell"), F.count_if(~F.col("visits"))).first()
    assert cells > 2 * labels and homes == alone.count()


def brute_vectors(rows, threshold):
    good = [(i, np.array(e, float), lab) for i, e, lab in rows if i is not None and lab is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links = set()
    for k, (i, x, a) in enumerate(good):
        for j, y, b in good[:k]:
            if a == b and i != j and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links |= {(i, j), (j, i)}
    return links


@pytest.mark.parametrize(("cell", "block"), [(16_384, 1024), (20, 7)])
def test_near_duplicate_vectors(spark, cell, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = [(int(i), (base[i % 12] + rng.normal(scale=0.06, size=8)).astype(np.float32).tolist(), int(i % 3)) for i in range(150)]
    rows += [(200 + i, rows[5][1], rows[5][2]) for i in range(6)] + [(5, rows[5][1], rows[5][2])]  # copies and a repeated row
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [None] * 8, 1), (303, [math.nan] * 8, 1), (304, [math.inf] * 8, 1), (305, rows[5][1], None), (306, rows[5][1][:4], rows[5][2]), (None, rows[5][1], rows[5][2]), (307, [], 1), (308, [-x for x in rows[5][1]], rows[5][2])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep long, cell string")
    got = vectors.near_duplicates(df, cell=cell, block=block).collect()
    links = brute_vectors(rows, 0.98)
    ids = {r[0] for r in rows if r[0] is not None}
    want = classes(ids, links)
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is None:
            assert r["component_id"] is None and r["n_links"] == 0
            continue
        assert r["n_links"] == sum(a == r["vec_id"] for a, _ in links), r
        assert (r["component_id"], r["kept"]) == (want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"])
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def brute_sets(rows, num, den):
    sets = {}
    for i, t in rows:
        w = SPACE.findall(low(t))
        k = min(3, len(w))
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set())
    links = set()
    flat = [(i, s) for i, found in sets.items() for s in found if s and i is not None]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            if i != j and den * len(a & b) >= num * len(a | b):
                links |= {(i, j), (j, i)}
    return sets, links


@pytest.mark.parametrize(("num", "members"), [(90, 48), (90, 2), (60, 3)])
def test_jaccard_join(spark, num, members):
    found = texts(160, seed=num + members)
    rows = list(enumerate(found)) + [(1000 + i, found[20]) for i in range(15)] + [(20, found[20]), (None, found[20]), (None, None)]
    got = jaccard.similarity_join(documents(spark, rows), num=num, members=members).collect()
    sets, links = brute_sets(rows, num, 100)
    want = classes({i for i, _ in rows if i is not None}, links)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_links"] == 0
            continue
        assert r["n_shingles"] == len(sets[r["doc_id"]][0]) and r["component_id"] == want[r["doc_id"]], r
        assert r["n_links"] == sum(a == r["doc_id"] for a, _ in links), r


def test_jaccard_join_of_nothing(spark):
    assert jaccard.similarity_join(documents(spark, [(1, "a b c")]).limit(0)).count() == 0
    (r,) = jaccard.similarity_join(documents(spark, [(1, None)])).collect()
    assert (r["n_shingles"], r["component_id"]) == (0, 1)


def test_a_prefix_and_a_bound_lose_no_link():
    rng = random.Random(8)
    for _ in range(200):
        a = {rng.randrange(60) for _ in range(rng.randint(1, 40))}
        b = {x for x in a if rng.random() < 0.93} | {rng.randrange(60) for _ in range(rng.randint(0, 3))}
        if b and 100 * len(a & b) >= 90 * len(a | b):
            pre = [sorted(s)[: len(s) - jaccard.need(len(s), 90, 100) + 1] for s in (a, b)]
            assert set(pre[0]) & set(pre[1])


def test_group_matrix_round_trip():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, 60).astype(np.uint64)) for _ in range(9)]
    union, matrix = jaccard.token_matrix(sets)
    back, bits = jaccard._unpack(len(sets), union.tobytes(), matrix)
    assert all((back[b.astype(bool)] == s).all() for b, s in zip(bits, sets, strict=True))
    links = jaccard.overlaps((back, bits), (back, bits), 30, 100)
    assert links.tolist() == [[100 * len(np.intersect1d(a, b)) >= 30 * len(np.union1d(a, b)) for b in sets] for a in sets]


def test_groups_of_one_cluster_are_connected_by_few_edges(spark):
    """Two groups of near copies: one edge connects them, counts of links are told only where they are asked for."""
    rng = random.Random(4)
    base = [rng.getrandbits(60) for _ in range(300)]
    sets = [np.sort(np.array(base + [rng.getrandbits(60)], np.uint64)) for _ in range(40)]
    row = {}
    for n, own in ((1, range(20)), (2, range(20, 40))):
        union, matrix = jaccard.token_matrix([sets[i] for i in own])
        row |= {f"reps{n}": list(own), f"mults{n}": [1] * 20, f"tokens{n}": union.tobytes(), f"matrix{n}": matrix}
    edges, counts = jaccard._open(row, 80, 100, True)
    assert edges == [(20, 0)] and counts == [(i, 20) for i in range(40)]
    assert jaccard._open(row, 80, 100, False) == ([(20, 0)], [])
    alone = row | {f"{c}2": None for c in ("reps", "mults", "tokens", "matrix")}
    assert sorted(jaccard._open(alone, 80, 100, False)[0]) == [(i, 0) for i in range(1, 20)]


def cluster(n, size=300, seed=4):
    rng = random.Random(seed)
    base = [rng.getrandbits(60) for _ in range(size)]
    return [np.sort(np.array(base + [rng.getrandbits(60)], np.uint64)) for _ in range(n)]


def test_a_cell_gives_one_row_of_each_kind_for_a_document():
    """Forty near copies in groups of four: 45 meetings, 39 edges and 40 counts."""
    sets = cluster(40)
    members = pa.table({"gid": [i // 4 for i in range(40)], "rep": list(range(40)), "mult": [1] * 40, "tokens": [s.tobytes() for s in sets]})
    met = [(a, b) for a in range(10) for b in range(a, 10)]
    pairs = pa.table({"g1": [a for a, _ in met], "g2": [b for _, b in met]})
    rows = jaccard._compare(members, pairs, 80, 100, True).to_pylist()
    assert sorted((r["a"], r["b"]) for r in rows if r["b"] is not None) == [(i, 0) for i in range(1, 40)]
    assert sorted((r["a"], r["links"]) for r in rows if r["b"] is None) == [(i, 39) for i in range(40)]


def test_a_group_goes_once_to_the_cell_of_its_cluster(spark):
    """A cluster of 30 groups that all meet is one cell while it fits; beyond that a group goes to as many as there are slots."""
    sets = spark.range(60).select((F.col("id") % 30).alias("gid"), F.lit(100).cast("long").alias("n"))
    pairs = spark.range(30).select(F.col("id").alias("g1")).crossJoin(spark.range(30).select(F.col("id").alias("g2"))).filter("g1 <= g2")
    for room, most in ((1 << 20, 1), (60 * 800 // 4, 4)):
        dealt = jaccard.cells(sets, pairs, room).collect()
        assert sorted((r["g1"], r["g2"]) for r in dealt) == sorted((a, b) for a in range(30) for b in range(a, 30))
        sent = {(r["cell"], g) for r in dealt for g in (r["g1"], r["g2"])}
        assert len(sent) <= 30 * most


@pytest.mark.parametrize("room", [1 << 10, 1 << 16])
def test_small_cells_give_the_same(spark, room):
    found = texts(120, seed=5)
    rows = list(enumerate(found)) + [(500 + i, f"{found[20]} w{i}") for i in range(12)]
    got = {tuple(r) for r in jaccard.similarity_join(documents(spark, rows), num=60, members=2, room=room).collect()}
    assert got == {tuple(r) for r in jaccard.similarity_join(documents(spark, rows), num=60, members=48).collect()}
