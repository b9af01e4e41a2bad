"""License scan by diagonal voting, in DataFrame functions only.

Every rolling word k-gram of a document whose hash stands in a template is joined to the template positions of that hash,
and compared word by word; a hit votes for the diagonal document position - template position. Neighbouring diagonals are
merged, and a merged group is verified by its words: the share of the template's words that its hits cover, and the length
of its span beside the template's.

Templates are whole texts of short public licences, notices and one-line statements (license_texts.py).
Scale: one scan writes ids, word counts and the few k-grams that stand in a template; words themselves are not written or
shuffled, and the arrays that they fill live for one row. The templates are fixed text, so the broadcast side has a fixed
size. The words that a group covers are bits of a fixed number of masks, so no list grows with a group.
Defined results: null and empty texts have no words and no labels; identical rows (same id and text) give identical
results; other columns are ignored; places may repeat and overlap, all are counted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import materialize
from lectern.llm.license_texts import BASE, NOTICES, TEXTS

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words whose bits one mask holds.
MASK = 62
#: A template of fewer words counts only in full.
SHORT = 12


def templates() -> list[tuple[str, str, bool, list[str]]]:
    """(template, label, is_base, words)."""
    split = lambda text: re.findall(r"[a-z0-9]+", text.lower())
    return [(f"base:{k}", k, True, split(t)) for k, t in BASE.items()] + [(f"own:{k}", k, False, split(t)) for k, t in (TEXTS | NOTICES).items()]


def n_masks() -> int:
    return 1 + max(len(words) - 1 for *_, words in templates()) // MASK


def grid() -> list[tuple]:
    """(template, label, is_base, n_template, t_pos, k, g0, g1, g2, masks) of each k-gram of each template."""
    out = []
    for name, label, is_base, words in templates():
        k = min(3, len(words))
        for i in range(len(words) - k + 1):
            masks = [sum(1 << (p % MASK) for p in range(i, i + k) if p // MASK == m) for m in range(n_masks())]
            out.append((name, label, is_base, len(words), i, k, *words[i : i + k], *[""] * (3 - k), masks))
    return out


def _gram(k: Column, a: Column, b: Column, c: Column) -> Column:
    return F.xxhash64(k, a, b, F.when(k == 3, c).otherwise(F.lit("")))


def candidates(docs: DataFrame, hashes: list[int]) -> DataFrame:
    """doc_id, row_key, n_words, grams (pos, w0, w1, w2) of the places where a k-gram of these hashes begins."""
    rows = grid()
    listed = lambda words: ", ".join(f"'{w}'" for w in sorted(set(words)))
    first, known = listed(r[6] for r in rows), ", ".join(map(str, hashes))
    # words decide before hashes, which cost more
    part = lambda k: f"get(words, i + 1) IN ({listed(r[7] for r in rows if r[5] == k)}) AND xxhash64({k}, get(words, i), get(words, i + 1), {'get(words, i + 2)' if k == 3 else repr('')}) IN ({known})"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the Kelvin sign is the one letter beyond A-Z that lower() turns into ASCII
    folded = F.lower(F.replace(text, F.lit("\u212a"), F.lit("å")))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), F.regexp_extract_all(folded, F.lit(WORD), F.lit(0)).alias("words"))
    w = lambda i: F.get("words", i)
    n = F.size("words")
    found = F.expr(f"filter(sequence(0, size(words) - 2), i -> get(words, i) IN ({first}) AND (({part(3)}) OR ({part(2)})))")
    places = F.when(n >= 2, found).otherwise(F.array().cast("array<int>"))
    grams = F.transform(places, lambda i: F.struct(i.cast("long").alias("pos"), w(i).alias("w0"), w(i + 1).alias("w1"), F.coalesce(w(i + 2), F.lit("")).alias("w2")))
    return words.select("doc_id", "row_key", n.cast("long").alias("n_words"), grams.alias("grams"))


def scan(docs: DataFrame, gap: int = 3, coverage: float = 0.8, longer: float = 1.25) -> DataFrame:
    """doc_id, n_words, base places, own verified spans, and the best coverage of these (0 without one) for each row.

    best: the greatest coverage of any merged diagonal, of base phrases and of spans that fail the verification too.
    base: array of (label, start); own: array of (label, start, end, coverage). gap: diagonals this close are merged.
    coverage: least share of a template's words; longer: most words of a span for each of the template's.
    """
    spark = docs.sparkSession
    masks = [f"m{i}" for i in range(n_masks())]
    known = spark.createDataFrame(grid(), "template string, label string, is_base boolean, n_template int, t_pos int, k int, g0 string, g1 string, g2 string, masks array<long>")
    known = known.select("*", *(F.get("masks", i).alias(m) for i, m in enumerate(masks))).drop("masks").withColumn("h", _gram(F.col("k"), F.col("g0"), F.col("g1"), F.col("g2")))
    # as many numbers as the templates have k-grams
    rows = materialize(candidates(docs, sorted(r["h"] for r in known.select("h").distinct().collect())), "license-grams")
    hot = rows.filter(F.size("grams") > 0)
    gram = hot.select("doc_id", "row_key", F.explode("grams").alias("g")).select("doc_id", "row_key", "g.*", F.explode(F.array(F.lit(2), F.lit(3))).alias("k_doc"))
    gram = gram.withColumn("h_doc", _gram(F.col("k_doc"), F.col("w0"), F.col("w1"), F.col("w2")))
    same = (F.col("h_doc") == F.col("h")) & (F.col("k_doc") == F.col("k")) & (F.col("w0") == F.col("g0")) & (F.col("w1") == F.col("g1")) & ((F.col("k") == 2) | (F.col("w2") == F.col("g2")))
    votes = gram.join(F.broadcast(known), same).withColumn("diagonal", F.col("pos") - F.col("t_pos"))
    keys = ["doc_id", "row_key", "template", "label", "is_base", "n_template"]
    lines = votes.groupBy(*keys, "diagonal").agg(*(F.bit_or(m).alias(m) for m in masks), F.min("pos").alias("first"), (F.max("pos") + F.max("k")).alias("end"))
    along = Window.partitionBy("doc_id", "row_key", "template").orderBy("diagonal")
    new = F.when(F.col("is_base") | F.lag("diagonal").over(along).isNull() | (F.col("diagonal") - F.lag("diagonal").over(along) > gap), 1).otherwise(0)
    groups = lines.withColumn("new", new).withColumn("group", F.sum("new").over(along))
    merged = groups.groupBy(*keys, "group").agg(*(F.bit_or(m).alias(m) for m in masks), F.min("first").alias("start"), F.max("end").alias("end"))
    covered = F.bit_count(masks[0])
    for m in masks[1:]:
        covered = covered + F.bit_count(m)
    merged = merged.withColumn("coverage", covered / F.col("n_template"))
    ok = (F.col("coverage") >= F.when(F.col("n_template") < SHORT, 1.0).otherwise(coverage)) & (F.col("end") - F.col("start") <= longer * F.col("n_template"))
    base = F.when(F.col("is_base"), F.struct("label", "start"))
    own = F.when(~F.col("is_base") & ok, F.struct("label", "start", "end", "coverage"))
    found = merged.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list(base)).alias("base"), F.array_sort(F.collect_list(own)).alias("own"), F.max(own["coverage"]).alias("score"), F.max("coverage").alias("best"))
    found = found.select(F.col("doc_id").alias("f_id"), F.col("row_key").alias("f_key"), "base", "own", "score", "best")
    blank = {"base": "array<struct<label:string,start:bigint>>", "own": "array<struct<label:string,start:bigint,end:bigint,coverage:double>>"}
    fill = [F.coalesce(F.col(c), F.array().cast(t)).alias(c) for c, t in blank.items()]
    joined = hot.join(found, (F.col("row_key") == F.col("f_key")) & F.col("doc_id").eqNullSafe(F.col("f_id")), "left").select("doc_id", "n_words", *fill, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("score", "best")))
    cold = rows.filter(F.size("grams") == 0).select("doc_id", "n_words", *(F.array().cast(t).alias(c) for c, t in blank.items()), F.lit(0.0).alias("score"), F.lit(0.0).alias("best"))
    return joined.unionByName(cold)
