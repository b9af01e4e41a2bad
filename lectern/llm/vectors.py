"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one vector kept per group.

Vectors are compared only within a label. Every label has centres: one for each `fine` vectors up to 8, and beyond that one
for each `cell` vectors, as powers of two (a cell more costs visits, see below, so large labels have larger cells).
Each vector has a home cell, that of its nearest centre. Two linked vectors of unit length lie at most
d = sqrt(2 - 2 * threshold) apart, so if their homes differ, each lies within d of the plane that halves the way between
both centres: it visits every cell of smaller number whose plane is that near. Each pair is thus compared in exactly one
cell, home with home or home with visitor, and no link is lost, whatever the centres are.

That reach is exact and wide where vectors fill the sphere evenly: visits, not homes, then make most of the work. `reach`
below 1 narrows it in proportion, for data that outgrow an exact search; half the way keeps all links but a few in a
thousand among 64 evenly filled dimensions.

Scale: centres are fitted on a bounded sample (`fit_rows`) for each number of cells that some label needs, `max_cells` at
most; every vector is assigned. Cells are cut into blocks by a hash, and blocks are compared pair by pair, so a hot cell
becomes many tasks of bounded memory. Only link counts and component edges leave a block pair, never all its pairs. Equal
vectors are joined into one with a multiplicity beforehand.
Defined results: null, zero or non-finite vectors and those without label link with nothing; vectors of different length
do not compare; a vector is scaled by its largest component before its norm is taken, so no finite one overflows; a null
id has no component; rows that share an id are one node; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import lean, materialize, small
from lectern.llm.graph import components
from lectern.llm.jaccard import stars


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, as squares may leave the range of doubles."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 9) -> np.ndarray:
    """Unit centres of k cells by cosine."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _fit(valid: DataFrame, levels: list[int], fit_rows: int) -> dict[tuple[int, int], np.ndarray]:
    """2 ** level centres for each vector length of the sample, which has at most fit_rows vectors, and each level."""
    sample = valid.orderBy("h", "vec_id").limit(fit_rows).select("vec_id", "x").toPandas() if levels else None
    out: dict[tuple[int, int], np.ndarray] = {}
    for dim, part in sample.groupby(sample["x"].map(len)) if levels else ():
        x = unit(np.stack(part.sort_values("vec_id")["x"].to_list()).astype(np.float64))
        for level in levels:
            out[int(dim), level] = spherical_kmeans(x, 1 << level)
    return out


def _cells(x: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home of each unit vector, and (row, cell) of its visits."""
    gap = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    sim = x @ centres.T
    home = sim.argmax(axis=1)
    best = sim[np.arange(len(x)), home][:, None]
    near = (best - sim <= reach * gap[home] + 1e-9) & (np.arange(len(centres)) < home[:, None])
    row, cell = np.nonzero(near)
    return home, row, cell


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as unit rows in double precision."""
    flat = column.combine_chunks()
    return unit(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1))


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Link counts and component edges of one pair of blocks of one cell."""
    table = table.sort_by([("rep", "ascending"), ("visits", "ascending")])
    bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
    same = bi == bj
    block = table.column("block").to_numpy()
    left = table if same else table.filter(pa.array(block == bi))
    right = table if same else table.filter(pa.array(block == bj))
    if not len(left) or not len(right):
        return _FOUND.empty_table()
    x, y = _matrix(left.column("x")), _matrix(right.column("x"))
    at_home = [~t.column("visits").to_numpy() for t in (left, right)]
    # visitors are not compared with each other: their pairs meet elsewhere
    links = np.zeros((len(x), len(y)), bool)
    links[at_home[0]] = x[at_home[0]] @ y.T >= threshold
    links[np.ix_(~at_home[0], at_home[1])] = x[~at_home[0]] @ y[at_home[1]].T >= threshold
    mult = [t.column("mult").to_numpy() for t in (left, right)]
    nodes = left.column("rep").to_numpy()
    if same:
        np.fill_diagonal(links, False)
        counts = links @ mult[1]
    else:
        counts = np.r_[links @ mult[1], mult[0] @ links]
        nodes = np.r_[nodes, right.column("rep").to_numpy()]
    edges = stars(links, same)
    some = np.flatnonzero(counts)
    a = [int(nodes[i]) for i, _ in edges] + nodes[some].tolist()
    b = [int(nodes[j]) for _, j in edges] + [None] * len(some)
    return pa.table([pa.array(c, pa.int64()) for c in (a, b, [None] * len(edges) + counts[some].tolist())], schema=_FOUND)


def placement(valid: DataFrame, alone: DataFrame, threshold: float, cell: int, fine: int, max_cells: int, fit_rows: int, reach: float) -> DataFrame:
    """(label, dim, cell, rep, mult, visits, x): the home of each row of alone, and its visits.

    valid: all vectors, of which centres are fitted; alone: label, x, rep, mult."""
    per_label = valid.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    halvings = lambda size, most: F.least(F.ceil(F.log2(F.col("rows") / size)), F.lit(int(np.log2(most))))
    level = F.greatest(F.lit(0), halvings(fine, min(8, max_cells)), halvings(cell, max_cells)).cast("int")
    labels = materialize(per_label.select("label", level.alias("level")), "labels")
    # at most log2(max_cells) numbers
    centres = _fit(valid, sorted(r["level"] for r in labels.select("level").distinct().collect()), fit_rows)
    reach = reach * float(np.sqrt(2 - 2 * threshold))
    none = np.zeros(0, np.int64)

    def assign(batches):
        for pdf in batches:
            for (dim, level), part in pdf.groupby([pdf["x"].map(len), pdf["level"]]):
                for lo in range(0, len(part), 2048):
                    own = part.iloc[lo : lo + 2048]
                    # a length that the sample lacks is one cell
                    given = centres.get((int(dim), int(level)))
                    home, row, visited = (np.zeros(len(own), np.int64), none, none) if given is None else _cells(unit(np.stack(own["x"].to_list()).astype(np.float64)), given, reach)
                    row = np.r_[np.arange(len(own)), row]
                    out = own.iloc[row].assign(dim=int(dim), cell=np.r_[home, visited], visits=np.arange(len(row)) >= len(own))
                    yield out[["label", "dim", "cell", "rep", "mult", "visits", "x"]]

    kind = dict(alone.dtypes)["x"]
    return alone.join(small(labels), "label").mapInPandas(lean(assign), f"label string, dim int, cell long, rep long, mult long, visits boolean, x {kind}")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, cell: int = 512, fine: int = 24, max_cells: int = 4096, fit_rows: int = 20_000, block: int = 1024, reach: float = 1.0) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("x"))
    kind = "float" if "float" in dict(rows.dtypes)["x"] else "double"
    # adding 0.0 makes -0.0 and 0.0 one value
    rows = rows.withColumn("x", F.transform("x", lambda v: (v + F.lit(0.0)).cast(kind)))
    finite = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists("x", lambda v: v != 0)
    rows = rows.withColumn("valid", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))).withColumn("h", F.xxhash64("label", "x"))
    rows = materialize(rows, "vectors")
    valid = rows.filter("valid")
    alone = materialize(valid.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("mult")), "distinct-vectors")
    placed = materialize(placement(valid, alone, threshold, cell, fine, max_cells, fit_rows, reach), "cells")
    # a cell of more rows than a block takes is dealt out by a hash; every two of its blocks meet once
    wide = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = placed.join(wide, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep", "x"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other", "blocks")
    found = dealt.groupBy("label", "dim", "cell", "bi", "bj").applyInArrow(lambda table: _compare(table, threshold), "a bigint, b bigint, links bigint")
    found = materialize(found, "vector-links")
    classes = components(found.filter("b is not null").select("a", "b"))
    links = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    reps = alone.select("label", "x", "rep", "mult").join(classes, F.col("rep") == F.col("node"), "left").join(links, F.col("rep") == F.col("a"), "left")
    reps = reps.select(F.xxhash64("label", "x").alias("rh"), F.col("label").alias("rl"), F.col("x").alias("rx"), F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"))
    out = rows.join(reps, F.col("valid") & (F.col("h") == F.col("rh")) & (F.col("label") == F.col("rl")) & (F.col("x") == F.col("rx")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
