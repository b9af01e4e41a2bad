"""Spelling variant grouping: words of the corpus that differ by one letter, grouped under the more frequent spelling.

A word's mask holds, for each letter, whether it stands an odd number of times in the word. One inserted or deleted letter
flips one bit of the mask, one replaced letter at most two. The bits are dealt into three bands, so a band stays equal
under every edit, and two stay equal where the lengths differ. Words meet by equal bands:

- of equal length, by one equal band, the half of the word that the edit left alone (an edit stands in one half) and the length;
- of lengths n and n + 1, by two equal bands and the shorter length.

Masks of words that meet differ in at most two bits (one, where lengths differ), else they are no neighbours; what passes is
verified by the edit distance. No neighbour is missed and none is reported twice. Bits go to bands by their entropy over the
vocabulary (64 sums), so that no band is nearly constant.

Occurrences are counted inside the tasks before anything is shuffled; all later work is on distinct words. A word's form is
its most frequent neighbour, if that one is at least `ratio` times as frequent; forms are followed to the last by pointer
doubling, in as many rounds as the logarithm of the longest chain.

Every 97th occurrence, by a hash of its document and word, is read with one letter missing; that is the operator's stated
reading of the corpus, which `garble=None` turns off.

Defined results: null texts have no words; a null id counts as the empty text; repeated rows count again; of neighbours of
equal frequency the smallest in code-point order is the form; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import lean, materialize, slices

#: Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, after A-Z are folded.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
FOLD = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))
SLICE = 1 << 20
#: Distinct words that a task holds before it hands on their counts.
HELD = 500_000
BITS = 64


def words(docs: DataFrame, least_length: int = 5, least_count: int = 3, garble: int | None = 97) -> DataFrame:
    """(word, n): words of at least least_length code points that occur at least least_count times."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def count(batches):
        held: Counter = Counter()

        def summed():
            # a word's bytes are at least its code points
            found = [w for w in held if len(w) >= least_length]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string()), pa.array([held[w] for w in found], pa.int64())], names=["word", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    runs = RUN.findall(text.translate(FOLD))
                    if garble is None:
                        held.update(runs)
                        continue
                    seed, own = zlib.crc32(f"{doc_id}:".encode()), Counter(runs)
                    for run in [w for w in own if not zlib.crc32(w, seed) % garble]:
                        letters = run.decode()
                        at = zlib.crc32(run, seed) % len(letters)
                        held[(letters[:at] + letters[at + 1 :]).encode()] += own.pop(run)
                    held.update(own)
                if len(held) > HELD:
                    yield from summed()
        yield from summed()

    counts = rows.mapInArrow(lean(count), "word string, n bigint").filter(F.length("word") >= least_length)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _bit(letter: Column) -> Column:
    """A letter's bit: a-z have one each, those from U+00C0 on share 38 (an edit flips two bits at most all the same)."""
    code = F.ascii(letter)
    return F.when(code < 128, code - 97).otherwise(26 + F.pmod(code - 192, F.lit(BITS - 26)))


def parity_mask(word: Column) -> Column:
    letters = F.split(word, "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda mask, letter: mask.bitwiseXOR(F.when(letter == "", F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(letter)))))


def _signed(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def bands(masked: DataFrame) -> list[int]:
    """Three masks of bits: each next bit, by falling entropy, goes to the band of the least entropy so far."""
    on = masked.agg(F.count(F.lit(1)).alias("rows"), *(F.sum(F.call_function("shiftrightunsigned", F.col("mask"), F.lit(b)).bitwiseAND(F.lit(1))).alias(str(b)) for b in range(BITS))).first()
    spread = {b: min(on[str(b)] or 0, on["rows"] - (on[str(b)] or 0)) for b in range(BITS)}
    dealt: list[list[int]] = [[], [], []]
    for b in sorted(spread, key=lambda b: (-spread[b], b)):
        min(dealt, key=lambda band: (sum(spread[x] for x in band), len(band))).append(b)
    return [_signed(band) for band in dealt]


def _one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(a, b), a before b: all pairs of words that differ by one inserted, deleted or replaced code point; word: distinct."""
    masked = materialize(vocabulary.select("word", F.length("word").alias("size"), parity_mask(F.col("word")).alias("mask")), "masks")
    dealt = [F.lit(m).cast("long") for m in bands(masked)]
    part = lambda k: F.col("mask").bitwiseAND(dealt[k])
    apart = lambda least: F.bit_count(F.col("x.mask").bitwiseXOR(F.col("y.mask"))) <= least

    # replaced letters: one band and one half are equal
    half = F.floor(F.col("size") / 2).cast("int")
    sides = [F.substring("word", F.lit(1), half), F.substring("word", half + 1, F.col("size"))]
    keys = F.array(*(F.struct(F.lit(2 * k + side).alias("which"), part(k).alias("band"), sides[side].alias("rest")) for k in range(3) for side in range(2)))
    same = masked.select("word", "size", "mask", F.explode(keys).alias("key")).select("word", "size", "mask", "key.*")
    met = same.alias("x").join(same.alias("y"), ["size", "which", "band", "rest"]).filter((F.col("x.word") < F.col("y.word")) & apart(2) & _one_edit(F.col("x.word"), F.col("y.word")))
    replaced = met.select(F.col("x.word").alias("a"), F.col("y.word").alias("b"))

    # a letter more: two bands are equal
    two = F.array(*(F.struct(F.lit(k).alias("which"), (dealt[(k + 1) % 3].bitwiseOR(dealt[(k + 2) % 3])).bitwiseAND(F.col("mask")).alias("band")) for k in range(3)))
    keyed = masked.select("word", "size", "mask", F.explode(two).alias("key")).select("word", "size", "mask", "key.*")
    longer = keyed.withColumn("size", F.col("size") - 1)
    met = keyed.alias("x").join(longer.alias("y"), ["size", "which", "band"]).filter(apart(1) & _one_edit(F.col("x.word"), F.col("y.word")))
    added = met.select(F.least("x.word", "y.word").alias("a"), F.greatest("x.word", "y.word").alias("b"))
    return replaced.unionByName(added).distinct()


def roots(forms: DataFrame, most: int = 64) -> DataFrame:
    """(word, root) for rows (word, form) without circles: the last word that forms lead to, by pointer doubling."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(most):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        step = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now
    raise RuntimeError("forms lead in a circle")


def group(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, garble: int | None = 97) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word; form and form_n are null where no neighbour is frequent enough."""
    known = materialize(words(docs, least_length, least_count, garble), "words")
    pairs = materialize(neighbours(known), "neighbours")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = both.join(known.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    # the largest n, then the smallest word
    best = other.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("best")).select(F.col("a").alias("word"), "n_near", F.col("best.b").alias("near"), (-F.col("best.less")).alias("near_n"))
    rows = known.join(best, "word", "left")
    chosen = F.col("near_n") >= ratio * F.col("n")
    rows = rows.select("word", F.when(chosen, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("near_n")).alias("form_n"))
    rows = materialize(rows, "spellings")
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
