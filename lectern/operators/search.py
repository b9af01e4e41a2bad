"""Library search: index rows, substring and ranked search for many queries at once, history, previews, match ranges.

A query whose terms all have three characters or more is ranked by BM25 over trigrams, where a term's phrase of trigrams
is its case-folded substring; any other query is one substring, newest first. Terms are literals inside one scan of the
index rows (a stated query set); with many documents and rare terms, `trigram_candidates` narrows the rows beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import patterns
from lectern.schema import CLIPPINGS_URL

K1, B = 1.2, 0.75
#: The least inverse document frequency, for terms in more than half of the rows.
LEAST_IDF = 1e-6


def _join(*columns: str) -> Column:
    out: Column = F.coalesce(F.col(columns[0]), F.lit(""))
    for c in columns[1:]:
        out = F.concat(out, F.lit("\n"), F.coalesce(F.col(c), F.lit("")))
    return out


def index_rows(articles: DataFrame, feeds: DataFrame, selections: DataFrame, article_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(kind, source_id, article_id, feed_id, title, body, snippet, timestamp, archived).

    kind: 0 article, 1 clipping, 2 favourite passage, 3 comment. An article's body holds its tags.
    """
    return article_rows(articles, feeds, article_tags, tags).unionByName(passage_rows(articles, selections))


def article_rows(articles: DataFrame, feeds: DataFrame, article_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """The index rows of articles and clippings: their texts are dealt once, by id, to their tags."""
    names = article_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "name"))), lambda x: x["name"]), " ").alias("tags"))
    # feeds are few, an id and a mark each: they go to the articles, as a join by feed would send all texts of one to one task
    kinds = feeds.select(F.col("id").alias("f_id"), (F.col("url") == CLIPPINGS_URL).cast("int").alias("kind"))
    rows = articles.join(F.broadcast(kinds), F.col("feed_id") == F.col("f_id"))
    shown = F.trim(F.concat(F.coalesce("title", F.lit("")), F.when(F.col("title").isNotNull() & F.col("content").isNotNull(), "\n").otherwise(""), F.coalesce("content", F.lit("")), F.when(F.col("url").isNotNull(), F.concat(F.lit("\n"), "url")).otherwise("")))
    full = rows.join(names, F.col("id") == names["article_id"], "left")
    return full.select("kind", F.col("id").alias("source_id"), F.col("id").alias("article_id"), "feed_id", "title", F.trim(_join("title", "author", "content", "url", "tags")).alias("body"), shown.alias("snippet"), F.coalesce("published", "fetched_at").alias("timestamp"), "archived")


def passage_rows(articles: DataFrame, selections: DataFrame) -> DataFrame:
    """The index rows of favourite passages and comments, with what they show of their articles."""
    parent = articles.select(F.col("id").alias("article_id"), "feed_id", "title", "archived")
    passages = selections.join(parent, "article_id")
    part = lambda kind, text, keep: passages.filter(keep).select(F.lit(kind).alias("kind"), F.col("id").alias("source_id"), "article_id", "feed_id", "title", F.col(text).alias("body"), F.col(text).alias("snippet"), F.col("updated_at").alias("timestamp"), "archived")
    noted = F.col("comment").isNotNull() & (F.length(F.trim("comment")) > 0)
    return part(2, "selected_text", F.col("is_favorite")).unionByName(part(3, "comment", noted))


def is_ranked(query: str) -> bool:
    return all(len(t) >= 3 for t in query.split())


def occurrences(body: Column, term: str) -> Column:
    """Overlapping occurrences of a literal."""
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_count(body, F.lit(f"(?={quoted})"))


def contains_all(body: Column, terms: list[str]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & F.contains(body, F.lit(t.lower()))
    return out


def search_short(rows: DataFrame, query: str, limit: int) -> DataFrame:
    """The whole query as one case-folded substring, newest first."""
    query = query.strip()
    hits = rows.filter(F.contains(F.lower("body"), F.lit(query.lower()))) if query and limit else rows.limit(0)
    return hits.orderBy(F.desc("timestamp"), F.desc("article_id"), "kind", "source_id").limit(limit).select("kind", "source_id", "article_id", "feed_id", "title", "snippet", "timestamp", "archived")


def bm25(rows: DataFrame, queries: dict[int, str], limit: int) -> DataFrame:
    """The best `limit` rows of each ranked query: query_id, rank and the hit, by score, newest, article.

    One scan counts all terms; the statistics that the score needs (rows, mean length, rows with each term) are one row.
    """
    terms = sorted({t.lower() for q in queries.values() for t in q.split()})
    if not terms or limit <= 0:
        return rows.limit(0).select(F.lit(0).alias("query_id"), F.lit(0).alias("rank"), "kind", "source_id", "article_id", "feed_id", "title", "timestamp", "archived", F.lit(0.0).alias("score"))
    counted = rows.withColumn("low", F.lower("body")).select("kind", "source_id", "article_id", "feed_id", "title", "timestamp", "archived", (F.length("low") - 2).alias("size"), *(F.when(F.contains("low", F.lit(t)), occurrences(F.col("low"), t)).otherwise(0).alias(f"tf{i}") for i, t in enumerate(terms)))
    stats = counted.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("size").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    n, mean = stats["n_rows"], stats["mean"] or 1.0

    def weight(i: int) -> Column:
        import math

        df = stats[f"df{i}"]
        idf = math.log((n - df + 0.5) / (df + 0.5)) if n else 0.0
        f = F.col(f"tf{i}")
        return F.lit(idf if idf > 0 else LEAST_IDF) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("size") / mean))

    found = []
    for key, query in queries.items():
        own = [terms.index(t) for t in dict.fromkeys(x.lower() for x in query.split())]
        every, total = F.lit(True), F.lit(0.0)
        for i in own:
            every, total = every & (F.col(f"tf{i}") > 0), total + weight(i)
        found.append(F.when(every, F.struct(F.lit(key).alias("query_id"), (-total).alias("score"))))
    hits = counted.withColumn("hit", F.explode(F.filter(F.array(*found), lambda h: h.isNotNull()))).select("hit.*", "kind", "source_id", "article_id", "feed_id", "title", "timestamp", "archived")
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9), F.desc("timestamp"), F.desc("article_id"), "kind", "source_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).select("query_id", "rank", "kind", "source_id", "article_id", "feed_id", "title", "timestamp", "archived", "score")


def search_library(rows: DataFrame, query: str, limit: int) -> DataFrame:
    """One query as a reader types it; blank queries and limit 0 find nothing."""
    query = query.strip()
    if not query or limit <= 0 or not is_ranked(query):
        return search_short(rows, query, limit)
    hits = bm25(rows, {0: query}, limit)
    found = rows.join(hits.select("kind", "source_id"), ["kind", "source_id"], "left_semi")
    shown = hits.join(snippets(found, ["kind", "source_id"], "body", query), ["kind", "source_id"])
    return shown.orderBy("rank").select("kind", "source_id", "article_id", "feed_id", "title", "snippet", "timestamp", "archived")


def search_and_record(rows: DataFrame, history: DataFrame, query: str, limit: int, now: int) -> tuple[DataFrame, DataFrame]:
    """(hits, history) of one query. Every search that has a query and a limit counts, also one without hits; the history
    keeps how many hits it showed."""
    hits = search_library(rows, query, limit)
    if not query.strip() or limit <= 0:
        return hits, history
    shown = hits.sparkSession.createDataFrame(hits.collect(), hits.schema)  # at most `limit` rows
    use = shown.agg(F.count(F.lit(1)).alias("result_count")).select(F.lit(query).alias("query"), F.lit(now).cast("long").alias("used_at"), "result_count")
    return shown, record_history(history, use)


def snippets(rows: DataFrame, keys: list[str], text: str, query: str) -> DataFrame:
    """(keys, snippet): where in its text the most of a query's terms meet; null where none stands."""
    return patterns.fragments(rows, keys, text, list(dict.fromkeys(patterns.folded(t) for t in query.split())))


def trigram_postings(rows: DataFrame) -> DataFrame:
    """(trigram, kind, source_id): the distinct trigrams of each row's folded body."""
    # one pass over each body: a look-ahead takes three characters at every place (but not from the middle of one)
    grams = F.regexp_extract_all(F.lower("body"), F.lit("(?s)(?=([^\\uDC00-\\uDFFF]..))"), F.lit(1))
    return rows.select("kind", "source_id", F.explode(F.array_distinct(grams)).alias("trigram"))


def trigram_candidates(postings: DataFrame, query: str) -> DataFrame:
    """(kind, source_id) of rows with all trigrams of all terms: a superset of the query's hits."""
    grams = sorted({t.lower()[i : i + 3] for t in query.split() for i in range(len(t) - 2)})
    return postings.filter(F.col("trigram").isin(grams)).groupBy("kind", "source_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select("kind", "source_id")


def record_history(history: DataFrame, uses: DataFrame) -> DataFrame:
    """Search history after uses (query, used_at, result_count): one row per query without regard to case.

    The first spelling stays, the count grows, time and result count are those of the last use. Blank queries are no use.
    """
    old = history.select("query", F.col("last_used_at").alias("used_at"), "use_count", "result_count", F.lit(0).alias("fresh"))
    new = uses.withColumn("query", F.trim("query")).filter("length(query) > 0").select("query", "used_at", F.lit(1).cast("long").alias("use_count"), "result_count", F.lit(1).alias("fresh"))
    last = F.max(F.struct("fresh", "used_at", "result_count"))
    both = old.unionByName(new).groupBy(F.lower("query").alias("key")).agg(F.min(F.struct("fresh", "used_at", "query"))["query"].alias("query"), last["used_at"].alias("last_used_at"), F.sum("use_count").alias("use_count"), last["result_count"].alias("result_count"))
    return both.drop("key")


def clear_history(history: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """The history without the named queries (column `query`, no regard to case), or without any."""
    if queries is None:
        return history.limit(0)
    gone = queries.select(F.lower(F.trim("query")).alias("_key")).distinct()
    return history.join(gone, F.lower("query") == F.col("_key"), "left_anti")


def recent_history(history: DataFrame, limit: int) -> DataFrame:
    return history.orderBy(F.desc("last_used_at"), "query").limit(limit)


def match_ranges(rows: DataFrame, query: str, keys: list[str], text: str) -> DataFrame:
    """(keys, start, end): byte ranges of the query's terms in a text column, overlapping or touching ones merged.

    Each term's matches do not overlap each other. Folding is by character; a range covers the original bytes.
    """
    terms = list(dict.fromkeys(patterns.folded(t) for t in query.split()))
    if not terms:
        return rows.limit(0).select(*keys, F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    return patterns.covered(rows, keys, text, terms)


def preview(text: Column, query: str, most: int = 180) -> Column:
    """A stretch of whitespace-collapsed text with a third of its room before the first term's match."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    first = query.split()[0].lower() if query.split() else ""
    at = F.instr(F.lower(flat), first) if first else F.lit(0)
    start = F.when(at > 0, F.greatest(F.lit(0), at - 1 - most // 3)).otherwise(0)
    end = F.least(F.length(flat), start + most)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.trim(F.substring(flat, start + 1, end - start)), F.when(end < F.length(flat), "…").otherwise(""))
    return F.when(F.length(flat) <= most, flat).otherwise(cut)
