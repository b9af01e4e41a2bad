"""Spelling variants against a brute-force version, and the mask's promise under every single edit."""

import random
import re
import zlib
from collections import Counter

from helpers import low, texts
from pyspark.sql import functions as F

from lectern.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(rows, garble=97):
    held = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if garble and h % garble == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            held[w] += 1
    return {w: n for w, n in held.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, garble=97):
    n = brute_words(rows, garble)
    form, out = {}, {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(close)
    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n[w], out[w], None if form[w] is None else n[form[w]]) for w in n}


def corpus(seed=2):
    """Texts of words and of their misspellings, with letters beyond ASCII."""
    rng = random.Random(seed)
    letters = "abcdeéÿÀxyz"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)]
    said = []
    for k, w in enumerate(base):
        for _ in range(8):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], w])
            said += [v] * rng.choice([1, 3, 4, 7, 15])
        said += [w] * (3 + k)
    rng.shuffle(said)
    rows = [(i, " ".join(said[i::97])) for i in range(97)] + [(200 + i, t) for i, t in enumerate(texts(40))]
    rows += [(None, "Straße straße strasse"), (300, None), (301, ""), (302, "q" * 20_000 + " a1b2 x"), *rows[:5]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "mask", "size", "form", "a", "b")})


def test_grouping(spark):
    for garble in (97, 3, None):
        got = spelling.group(frame(spark, corpus()), garble=garble).collect()
        want = brute(corpus(), garble)
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        assert garble != 97 or max(r["n_near"] for r in got) > 3 and sum(r["root"] != (r["form"] or r["word"]) for r in got) > 0


def test_no_rows(spark):
    assert spelling.group(frame(spark, [(1, None)]).limit(0)).count() == 0
    assert spelling.group(frame(spark, [(1, None), (2, "ab cd ab cd")])).count() == 0


def test_an_edit_flips_two_bits_at_most(spark):
    rng = random.Random(1)
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    rows = []
    for _ in range(400):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(5, 12)))
        i, c = rng.randrange(len(w)), rng.choice(letters)
        rows += [(w, w[:i] + w[i + 1 :], 1), (w, w[:i] + c + w[i:], 1), (w, w[:i] + c + w[i + 1 :], 2)]
    df = spark.createDataFrame(rows, "a string, b string, most int").withColumn("bits", F.bit_count(spelling.parity_mask(F.col("a")).bitwiseXOR(spelling.parity_mask(F.col("b")))))
    assert df.filter("bits > most").count() == 0 and df.filter("most = 1 and bits <> 1").count() == 0


def test_bands_part_the_bits(spark):
    masked = spark.createDataFrame([("abcdefgh",), ("xyzzy",), ("éàabc",)], "word string").select(spelling.parity_mask(F.col("word")).alias("mask"))
    masks = [m & (1 << 64) - 1 for m in spelling.bands(masked)]
    assert masks[0] | masks[1] | masks[2] == (1 << 64) - 1 and sum(m.bit_count() for m in masks) == 64


def test_chains_are_followed(spark):
    rows = [(f"w{i:03}", f"w{i + 1:03}") for i in range(45)] + [("v", "w010")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert set(got.values()) == {"w045"} and len(got) == 46
