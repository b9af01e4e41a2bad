"""The source divergence audit against a brute-force version in Python integers."""

import re
from collections import Counter, defaultdict

import pytest
from helpers import low, texts
from pyspark.sql import functions as F

from lectern.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, top):
    """rows of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    held = defaultdict(Counter)
    for text, lang, _ in rows:
        held[lang].update(set(TERM.findall(low(text))))
    kept = {lang: [t for t, n in c.items() if n >= min_docs] for lang, c in held.items()}
    counts = defaultdict(Counter)
    for text, lang, source in rows:
        counts[lang, source].update(t for t in TERM.findall(low(text)) if held[lang][t] >= min_docs)
        counts[lang].update(t for t in TERM.findall(low(text)) if held[lang][t] >= min_docs)
    p = lambda key, lang, t: 1 + 10**9 * (counts[key][t] + 2) // (sum(counts[key].values()) + 2 * len(kept[lang]))
    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = set()
    for lang, source in {r[1:] for r in rows}:
        others = {s for _, g, s in rows if g == lang} - {source}
        pairs = [(sum(f(p((lang, source), lang, t), p((lang, s), lang, t)) for t in kept[lang]), s) for s in others]
        used = [(f(p((lang, source), lang, t), p(lang, lang, t)), t) for t in kept[lang] if counts[lang, source][t] and p((lang, source), lang, t) > p(lang, lang, t)]
        for part, found in (("pair", pairs), ("term", used)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or rank <= top:
                    out.add((lang, source, part, item, value, rank))
    return out


def corpus():
    rows = [(t, "en" if i % 3 else "fr", f"s{i % 4}") for i, t in enumerate(texts(90))]
    rows += [("Éa éa A1b_c", None, None), (None, "en", "s9"), ("rare words only", "xx", "one"), (None, "yy", "a"), ("", "yy", None), ("z" * 70_000 + " ab ab", "en", "s1")]
    return rows + rows[20:30]


@pytest.mark.parametrize(("min_docs", "top", "pass_terms"), [(10, 10, 1 << 19), (3, 2, 40)])
def test_audit(spark, min_docs, top, pass_terms):
    rows = corpus()
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "count", "p", "at", "n", "item", "rank")})
    got = divergence.audit(df, min_docs, top, pass_terms).collect()
    assert {tuple(r) for r in got} == brute(rows, min_docs, top) and len(got) == len({tuple(r) for r in got})


def test_no_rows_and_no_terms(spark):
    schema = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    got = divergence.audit(spark.createDataFrame([("a b", "en", "x"), ("a b", "en", "y")], schema)).collect()
    assert {tuple(r) for r in got} == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


def test_shares_beyond_32_bits_are_exact(spark):
    pairs = [(0, 2), (7, 9), (10**13 + 7, 3 * 10**13 + 11), (8 * 10**15, 8 * 10**15 + 2), (123_456_789_012_345, 987_654_321_098_765)]
    got = [r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, c long, d long").orderBy("i").select(divergence.share(F.col("c"), F.col("d"))).collect()]
    assert got == [1 + 10**9 * (c + 2) // d for c, d in pairs]


def test_sources_in_several_tiles(spark):
    rows = [(t, "en", f"s{i % 8}") for i, t in enumerate(texts(80, 5))]
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"), 4, 3, tile=3, bucket=8).collect()
    assert {tuple(r) for r in got} == brute(rows, 4, 3)
