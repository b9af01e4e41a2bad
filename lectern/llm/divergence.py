"""Source divergence audit: how far the sources of a language differ in their use of its vocabulary.

Two passes over the texts. The first counts in how many documents of a language each term stands; terms of `min_docs`
documents or more are kept. The second recounts their occurrences for each (language, source) with an Aho-Corasick automaton
over the kept terms, each padded with a delimiter on both sides, so that only whole terms match. What it finds are sparse
postings (language, source, term, count); all else follows from them and from one number for the absent terms of a source.

A term is a run of letters A-Z and of characters beyond ASCII; only A-Z are folded. In each group g (a source of a language,
or the whole language) every kept term t has p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two groups differ in a term by
f = floor((p - q)^2 / (p + q)). All numbers are exact integers: the quotient is taken by long division in base 1000, which
holds up to 9 * 10^15 counted terms; counts are added as 64-bit integers.

Scale. Both passes are narrow scans with sums of a task's texts before any shuffle. The vocabulary is never broadcast whole:
it is cut into passes of at most `pass_terms` terms in the order of languages, and each pass reads the texts of its languages
only. Pairs of sources are compared in tiles of `tile` sources by buckets of about `bucket` terms, so no task holds a language's
whole vocabulary or all its sources, and a pair leaves a bucket as one partial sum.

Defined results: null text, lang and source count as ''; a language without a kept term gives its pairs with value 0; a
language with one source has no pairs; repeated rows count as documents of their own; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern import shared
from lectern.llm.common import lean, materialize, slices, small

#: A-Z are folded, all other ASCII but a-z parts terms.
FOLD = bytes((b | 32) if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SLICE = 1 << 20
#: Entries of a task's counts before they are handed on.
HELD = 400_000
#: Occurrences that are summed at once.
FOUND = 1 << 21


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def kept_terms(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(lang, term, n_docs) of the terms in at least min_docs documents of a language."""

    def count(batches):
        held: dict[str, Counter] = defaultdict(Counter)

        def rows():
            for lang, terms in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(list(terms.values()), pa.int64())], names=["lang", "term", "n_docs"])
            held.clear()

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    held[lang].update(set(text.translate(FOLD).split()))
                if sum(map(len, held.values())) > HELD:
                    yield from rows()
        yield from rows()

    parts = _texts(docs).select("lang", "text").mapInArrow(lean(count), "lang string, term string, n_docs bigint")
    return parts.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs")).filter(F.col("n_docs") >= min_docs)


#: Automata of the pass that this worker is in: they outlive a task.
_BUILT: dict[str, tuple] = {}


def _automata(key: str, table: pa.Table) -> tuple:
    """Terms and, by language, an automaton whose values are the terms' numbers."""
    import ahocorasick

    if key not in _BUILT:
        _BUILT.clear()
        built: dict = {}
        for n, (lang, term) in enumerate(zip(table.column("lang").to_pylist(), table.column("term").to_pylist(), strict=True)):
            if lang not in built:
                built[lang] = ahocorasick.Automaton()
            built[lang].add_word(f" {term} ", n)
        for automaton in built.values():
            automaton.make_automaton()
        _BUILT[key] = table.combine_chunks(), built
    return _BUILT[key]


def _recount(docs: DataFrame, terms: pa.Table) -> DataFrame:
    """(lang, source, term, count), partial: occurrences of a bounded list of (lang, term)."""
    sent, key = docs.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex
    langs = terms.column("lang").unique().to_pylist()
    rows = _texts(docs)
    rows = rows.filter(F.col("lang").isin(langs)) if len(langs) <= 256 else rows

    def count(batches):
        table, automata = _automata(key, sent.value)
        sources: dict[str, int] = {}
        found: list[np.ndarray] = []

        def summed():
            at, times = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
            source, term = np.divmod(at, max(1, table.num_rows))
            names = pa.array(list(sources), pa.string())
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column(c).take(pa.array(term)) for c in ("lang", "term"))]
            yield pa.RecordBatch.from_arrays([columns[0], names.take(pa.array(source)), columns[1], pa.array(times.astype(np.int64))], names=["lang", "source", "term", "count"])
            found.clear()
            sources.clear()

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = defaultdict(list)
                for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source")), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    if lang in automata:
                        texts[lang, source].append(text)
                for (lang, source), own in texts.items():
                    line = (b" " + b" ".join(own) + b" ").translate(FOLD).decode()
                    hits = np.fromiter((n for _, n in automata[lang].iter(line)), np.int64)
                    found.append(sources.setdefault(source, len(sources)) * table.num_rows + hits)
                if sum(map(len, found)) > FOUND:
                    yield from summed()
        if found:
            yield from summed()

    return rows.mapInArrow(lean(count), "lang string, source string, term string, count bigint")


def occurrences(docs: DataFrame, kept: DataFrame, pass_terms: int = 1 << 19) -> DataFrame:
    """(lang, source, term, count) of kept terms where they stand; kept: (lang, term), each pair once."""
    line = shared.numbered(kept.select("lang", "term"), ["lang", "term"])
    total, parts = line.count(), []
    for low in range(0, total, pass_terms):
        terms = line.filter((F.col("n") >= low) & (F.col("n") < low + pass_terms)).select("lang", "term").toArrow()
        parts.append(materialize(_recount(docs, terms).groupBy("lang", "source", "term").agg(F.sum("count").alias("count")), "term-counts"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "lang string, source string, term string, count bigint")
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)  # each term is in one pass only
    return counts


def share(count: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 2) / size) for count + 2 <= size < 9 * 10^15, without overflow."""
    rest, out = count + F.lit(2), F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * F.lit(1000)
        out = out * F.lit(1000) + F.call_function("div", rest, size)
        rest = rest % size
    return out + F.lit(1)


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(table: pa.Table, tile: int) -> pa.Table:
    """Partial sums of f for the pairs of two tiles over one bucket of terms.

    Rows without a term give the number of each source, its p for absent terms and how many terms the bucket holds; the
    others give the p of present terms. Terms that no source of the two tiles has differ by the same amount each."""
    at, low, high = (table.column(c).to_numpy() for c in ("at", "low", "high"))
    term, p = table.column("term").combine_chunks(), table.column("p").to_numpy()
    base = term.is_null().to_numpy(zero_copy_only=False)
    order = np.argsort(at[base])
    sources, absent = at[base][order], p[base][order]
    codes = term.filter(pa.array(~base)).dictionary_encode()
    grid = np.tile(absent, (max(1, len(codes.dictionary)), 1))
    seen, rest = len(codes.dictionary) > 0, int(table.column("held").to_numpy()[base].max()) - len(codes.dictionary)
    if seen:
        grid[codes.indices.to_numpy(), np.searchsorted(sources, at[~base])] = p[~base]
    a_s, b_s = np.flatnonzero(sources // tile == low[0]), np.flatnonzero(sources // tile == high[0])
    out = []
    for a in a_s:
        other = b_s[b_s > a]
        if len(other):
            mine, theirs = grid[:, a : a + 1], grid[:, other]
            total = ((mine - theirs) ** 2 // (mine + theirs)).sum(axis=0) if seen else np.zeros(len(other), np.int64)
            total = total + rest * ((absent[a] - absent[other]) ** 2 // (absent[a] + absent[other]))
            out.append((np.full(len(other), sources[a]), sources[other], total))
    a, b, value = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(a), pa.string()), "a": a, "b": b, "value": value})


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, pass_terms: int = 1 << 19, tile: int = 256, bucket: int = 4096) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks all other sources of the language by their distance, part
    `term` up to `top` terms that the source uses more than its language does."""
    kept = materialize(kept_terms(docs, min_docs), "kept-terms")
    counts = materialize(occurrences(docs, kept, pass_terms), "occurrences")
    by_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sums = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = _texts(docs).select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("at"))
    size = F.greatest(F.col("n") + 2 * F.col("v"), F.lit(2))
    groups = materialize(groups.withColumn("size", size).withColumn("tiles", F.count(F.lit(1)).over(Window.partitionBy("lang"))).withColumn("tiles", F.ceil(F.col("tiles") / tile)), "groups")
    few = small(groups)

    postings = counts.join(few, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("size")))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("v") / bucket)).cast("long")
    absent = groups.withColumn("term", F.lit(None).cast("string")).withColumn("p", share(F.lit(0).cast("long"), F.col("size"))).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1)))
    place = F.pmod(F.xxhash64("term"), buckets).alias("bucket")
    sizes = kept.join(small(by_lang), "lang").select("lang", place).groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("held"))
    absent = absent.join(small(sizes), ["lang", "bucket"], "left")
    columns = ["lang", "at", "term", "p", "tiles"]
    cells = postings.select(*columns, place, F.lit(0).cast("long").alias("held")).unionByName(absent.select(*columns, "bucket", F.coalesce("held", F.lit(0)).alias("held")))
    own = F.floor(F.col("at") / tile)
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles").cast("long") - 1)))
    cells = cells.select("lang", "bucket", "at", "term", "p", "held", F.least(own, "other").alias("low"), F.greatest(own, "other").alias("high"))
    pairs = cells.groupBy("lang", "bucket", "low", "high").applyInArrow(lambda table: _pair_sums(table, tile), "lang string, a bigint, b bigint, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = small(groups.select("lang", "at", "source"))
    named = both.join(names.withColumnRenamed("at", "a"), ["lang", "a"]).join(names.select("lang", F.col("at").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    whole = sums.groupBy("lang").agg(F.sum("n").alias("all"))
    shared_terms = counts.groupBy("lang", "term").agg(F.sum("count").alias("total"))
    usual = shared_terms.join(small(whole), "lang").join(small(by_lang), "lang").select("lang", "term", share(F.col("total"), F.col("all") + 2 * F.col("v")).alias("q"))
    more = postings.select("lang", "source", "term", "p").join(usual, ["lang", "term"]).filter("p > q")
    more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    best = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.unionByName(best)
