"""Quotation anchors: captured context, occurrences, and relocation after a text has changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import patterns


def capture(text: Column, start: Column, end: Column, context: int = 64) -> tuple[Column, Column, Column, Column]:
    """(start, end, prefix, suffix) of a range in characters, clamped to the text."""
    size = F.length(text)
    a = F.least(F.greatest(start, F.lit(0)), size)
    z = F.least(F.greatest(end, a), size)
    before = F.greatest(a - context, F.lit(0))
    return a, z, F.substring(text, before + 1, a - before), F.substring(text, z + 1, F.lit(context))


def quote_from_range(text: Column, one: Column, other: Column) -> Column:
    """(start, end, quote) of a range given in either order, without white space at its ends; null if nothing is left."""
    lo, hi = F.least(one, other), F.greatest(one, other)
    raw = F.substring(text, lo + 1, hi - lo)
    left = F.length(raw) - F.length(F.regexp_replace(raw, r"^\s+", ""))
    quote = F.regexp_replace(raw, r"^\s+|\s+$", "")
    return F.when(F.length(quote) > 0, F.struct((lo + left).alias("start"), (lo + left + F.length(quote)).alias("end"), quote.alias("quote")))


def positions(text: Column, quote: Column) -> Column:
    """Starts (from 0) of all occurrences of a quotation, overlapping ones too.

    The text is cut before each occurrence by a look-ahead, in one pass; the pieces' lengths give the starts.
    """
    literal = F.concat(F.lit("(?=\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    pieces = F.transform(F.split(text, literal, -1), lambda p: F.length(p))
    empty = F.array().cast("array<int>")
    step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"] + n).alias("out"))
    inner = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])
    starts = F.concat(F.when(text.startswith(quote), F.array(F.lit(0))).otherwise(empty), inner)
    return F.when((F.length(quote) > 0) & F.contains(text, quote), F.filter(F.array_distinct(starts), lambda p: p < F.length(text))).otherwise(empty)


def _same_end(a: Column, b: Column) -> Column:
    """How many characters two strings share counted from their ends."""
    n = F.least(F.length(a), F.length(b))
    ra, rb = F.reverse(a), F.reverse(b)
    return _same_start(ra, rb, n)


def _same_start(a: Column, b: Column, n: Column | None = None) -> Column:
    n = F.least(F.length(a), F.length(b)) if n is None else n
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(differ, 0) - 1, n))


def resolve(anchors: DataFrame, articles: DataFrame) -> DataFrame:
    """Where each anchor stands now: anchors' columns with new_start and new_end (null if the quotation is gone).

    anchors: article_id, quote, start_offset, end_offset, prefix, suffix. The stored range wins if it still holds the
    quotation; else the occurrence whose surroundings share most characters with the stored ones, then the nearest to
    the old start, then the first. Texts are joined by article, so no quotation meets a foreign text.
    """
    a = anchors.join(articles.select(F.col("id").alias("article_id"), F.coalesce("content", F.lit("")).alias("_text")), "article_id", "left")
    text, quote = F.coalesce(F.col("_text"), F.lit("")), F.col("quote")
    size = F.length(quote)
    old = F.col("start_offset").cast("int")
    stays = F.substring(text, old + 1, (F.col("end_offset") - F.col("start_offset")).cast("int")) == quote
    prefix, suffix = F.coalesce(F.col("prefix"), F.lit("")), F.coalesce(F.col("suffix"), F.lit(""))

    def rate(p: Column) -> Column:
        reach = F.length(prefix)
        before = F.substring(text, F.greatest(p - reach, F.lit(0)) + 1, F.least(p, reach))
        after = F.substring(text, p + size + 1, F.length(suffix))
        score = _same_end(before, prefix) + _same_start(after, suffix)
        return F.struct((-score).alias("s"), F.abs(p - F.coalesce(old, F.lit(0))).alias("d"), p.alias("p"))

    best = F.array_min(F.transform(positions(text, quote), rate))["p"]
    start = F.when(old.isNotNull() & F.col("end_offset").isNotNull() & stays & (old >= 0), old).otherwise(best)
    return a.withColumn("new_start", start.cast("long")).withColumn("new_end", (start + size).cast("long")).drop("_text")


def quote_occurrences(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """(item_id, doc_id, n): how often each quotation stands in each document, overlaps not counted; empty ones nowhere.

    All quotations are sought in one pass over each text, long and short ones alike."""
    return patterns.counts(documents, quotes)
