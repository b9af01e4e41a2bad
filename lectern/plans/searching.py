"""Queries of library search and anchors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import anchors, search, stored_index
from lectern.plans.registry import query
from lectern.shared import shared_root
from lectern.sources.domain import Domain

TERMS = {1: "thin ereth", 2: "license", 3: "nicht schen", 4: "version public", 5: "querés", 6: "apache version"}

_INDEX = r"""kinds AS (SELECT id AS f_id, CASE WHEN id = 0 THEN 1 ELSE 0 END AS kind FROM feeds),
names AS (SELECT l.article_id, string_agg(t.name, ' ' ORDER BY lower(t.name), t.name) AS tags FROM article_tags l JOIN tags t ON t.id = l.tag_id GROUP BY l.article_id),
idx AS (
  SELECT k.kind, a.id AS source_id, a.id AS article_id, a.feed_id, a.title,
    trim(coalesce(a.title, '') || chr(10) || coalesce(a.author, '') || chr(10) || coalesce(a.content, '') || chr(10) || coalesce(a.url, '') || chr(10) || coalesce(n.tags, ''), ' ') AS body,
    coalesce(a.published, a.fetched_at) AS timestamp, a.archived
  FROM articles a JOIN kinds k ON a.feed_id = k.f_id LEFT JOIN names n ON n.article_id = a.id
  UNION ALL SELECT 2, s.id, s.article_id, a.feed_id, a.title, s.selected_text, s.updated_at, a.archived FROM selections s JOIN articles a ON a.id = s.article_id WHERE s.is_favorite
  UNION ALL SELECT 3, s.id, s.article_id, a.feed_id, a.title, s.comment, s.updated_at, a.archived FROM selections s JOIN articles a ON a.id = s.article_id WHERE s.comment IS NOT NULL AND length(trim(s.comment)) > 0)"""
_TABLES = "feeds articles selections article_tags tags"


def _rows(d: Domain) -> DataFrame:
    return search.index_rows(d.articles(), d.feeds(), d.selections(), d.article_tags(), d.tags())


@query(f", {_INDEX} SELECT kind, source_id, article_id, feed_id, timestamp, archived, length(body) AS size, md5(body) AS body_md5 FROM idx", _TABLES)
def article_index_rows(d: Domain) -> DataFrame:
    return _rows(d).select("kind", "source_id", "article_id", "feed_id", "timestamp", "archived", F.length("body").cast("long").alias("size"), F.md5("body").alias("body_md5"))


@query(f", {_INDEX} SELECT kind, source_id, article_id, feed_id, timestamp, archived FROM idx WHERE contains(lower(body), 'ou') ORDER BY timestamp DESC, article_id DESC, kind, source_id LIMIT 50", _TABLES)
def search_short(d: Domain) -> DataFrame:
    return search.search_short(_rows(d), " OU ", 50).select("kind", "source_id", "article_id", "feed_id", "timestamp", "archived")


@query(f", {_INDEX} SELECT kind, source_id, article_id FROM idx WHERE contains(lower(body), 'license') AND contains(lower(body), 'the')", _TABLES)
def search_terms_and(d: Domain) -> DataFrame:
    return _rows(d).filter(search.contains_all(F.lower("body"), ["License", "the"])).select("kind", "source_id", "article_id")


def _bm25(queries: dict[int, str], limit: int) -> str:
    values = ", ".join(f"({k}, '{t}')" for k, q in queries.items() for t in dict.fromkeys(q.split()))
    sizes = ", ".join(f"({k}, {len(dict.fromkeys(q.split()))})" for k, q in queries.items())
    return f""", {_INDEX},
low AS (SELECT *, lower(body) AS b, length(lower(body)) - 2 AS size FROM idx), stats AS (SELECT count(*) AS n, avg(size) AS mean FROM low),
q(query_id, term) AS (VALUES {values}), sizes(query_id, terms) AS (VALUES {sizes}),
tf AS (SELECT q.query_id, q.term, l.kind, l.source_id, l.article_id, l.feed_id, l.timestamp, l.archived, l.size, ((length(b) - length(replace(b, q.term, ''))) / length(q.term))::BIGINT AS f FROM q JOIN low l ON contains(l.b, q.term)),
df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
idf AS (SELECT query_id, term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, stats),
hit AS (
  SELECT query_id, kind, source_id, article_id, feed_id, timestamp, archived, -sum(idf * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * size / mean))) AS score, count(*) AS terms
  FROM tf JOIN idf USING (query_id, term), stats GROUP BY ALL),
ranked AS (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), timestamp DESC, article_id DESC, kind, source_id) AS rank FROM hit h JOIN sizes USING (query_id, terms))
SELECT query_id, rank, kind, source_id, article_id, feed_id, timestamp, archived, round(score, 5) + 0.0 AS score FROM ranked WHERE rank <= {limit}"""


def _ranked(d: Domain, queries: dict[int, str], limit: int) -> DataFrame:
    return search.bm25(_rows(d), queries, limit).select("query_id", F.col("rank").cast("long").alias("rank"), "kind", "source_id", "article_id", "feed_id", "timestamp", "archived", (F.round("score", 5) + 0.0).alias("score"))


@query(_bm25({1: TERMS[1]}, 20), _TABLES)
def search_bm25_topk(d: Domain) -> DataFrame:
    return _ranked(d, {1: TERMS[1]}, 20)


@query(_bm25(TERMS, 10), _TABLES)
def search_multi_query(d: Domain) -> DataFrame:
    return _ranked(d, TERMS, 10)


def _stored(d: Domain, rows: DataFrame) -> stored_index.StoredIndex:
    index = stored_index.StoredIndex(d.spark, f"{shared_root(d.spark)}/index-{uuid.uuid4().hex[:12]}")
    # texts are dealt once, by id to their tags; postings stay where that leaves them
    index.build(rows, in_place=True)
    return index


@query(_bm25(TERMS, 10), _TABLES)
def search_stored_topk(d: Domain) -> DataFrame:
    """The same search from stored postings: bodies are not read, blocks that cannot reach the best ten are not opened."""
    found = _stored(d, _rows(d)).search(TERMS, 10)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "kind", "source_id", "article_id", "feed_id", "timestamp", "archived", (F.round("score", 5) + 0.0).alias("score"))


@query(f""", {_INDEX}, low AS (SELECT kind, source_id, string_split(lower(body), '') AS c FROM idx),
each AS (SELECT kind, source_id, unnest(c[:len(c) - 2]) || unnest(c[2:len(c) - 1]) || unnest(c[3:]) AS trigram FROM low WHERE len(c) > 2),
g AS (SELECT kind, source_id, trigram, count(*) AS tf FROM each GROUP BY ALL)
SELECT trigram, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM g GROUP BY trigram""", _TABLES)  # fmt: skip
def stored_index_after_changes(d: Domain) -> DataFrame:
    """An index of an earlier library, brought up to date by deltas, holds what a rebuild holds.

    Since then articles came (every 6th), changed (every 5th) and went (every 4th had a copy), tags were given (to every
    7th) and comments edited (of every 3rd selection)."""
    articles, feeds, selections, links, tags = d.articles(), d.feeds(), d.selections(), d.article_tags(), d.tags()
    i = F.col("id")
    gone = articles.filter(i % 4 == 0).withColumn("id", -1 - i)
    old = articles.filter(i % 6 != 0).withColumn("content", F.when(i % 5 == 0, F.concat(F.lit("Draft. "), F.reverse("content"))).otherwise(F.col("content")))
    noted = selections.withColumn("comment", F.when(i % 3 == 0, F.lit("to be written")).otherwise(F.col("comment")))
    given = links.filter("article_id % 7 <> 0")
    # apart, as the texts of a union would be dealt by id again
    index = _stored(d, search.article_rows(old, feeds, given, tags).unionByName(search.article_rows(gone, feeds, given, tags)).unionByName(search.passage_rows(old.unionByName(gone), noted)))
    changed = articles.filter((i % 6 == 0) | (i % 5 == 0) | (i % 7 == 0))
    ids = changed.select("id").unionByName(gone.select("id"))
    keys = stored_index.touched(articles, selections, links, article_ids=ids, selection_ids=selections.filter(i % 3 == 0).select("id"))
    # only changed articles' texts are dealt to their tags
    passages = search.passage_rows(articles, selections).join(keys, ["kind", "source_id"], "left_semi")
    index.update(keys, search.article_rows(changed, feeds, links, tags).unionByName(passages), narrowed=True, in_place=True)
    return index.trigram_counts()


@query("""WITH uses AS (SELECT CASE WHEN event_id % 2 = 0 THEN event_type ELSE upper(event_type) END AS query, epoch_us(ts) AS used_at, user_id::BIGINT AS n FROM events)
SELECT arg_min(query, row(used_at, query)) AS query, max(used_at) AS last_used_at, count(*) AS use_count, arg_max(n, row(used_at, n)) AS result_count FROM uses GROUP BY lower(query)""")  # fmt: skip
def search_history_upsert(d: Domain) -> DataFrame:
    from lectern.schema import TABLES

    name = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.upper("event_type"))
    uses = d.raw("events").select(name.alias("query"), F.unix_micros(F.col("ts").cast("timestamp")).alias("used_at"), F.col("user_id").cast("long").alias("result_count"))
    return search.record_history(d.spark.createDataFrame([], TABLES["search_history"]), uses)


@query(r"""WITH m AS (
  SELECT doc_id, p, length(t) AS n FROM (SELECT doc_id, lower(text) AS b, unnest(['the', 'heth']) AS t FROM documents), unnest(range(1, length(b) + 1)) AS u(p) WHERE substr(b, p, length(t)) = t),
k AS (SELECT doc_id, p AS a, p + n AS z FROM m),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, z) AS grp
  FROM (SELECT *, max(z) OVER (PARTITION BY doc_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)),
r AS (SELECT doc_id, min(a) AS a, max(z) AS z FROM g GROUP BY doc_id, grp)
SELECT r.doc_id, strlen(left(text, a - 1)) AS "start", strlen(left(text, z - 1)) AS "end" FROM r JOIN documents d ON d.doc_id = r.doc_id""")  # fmt: skip
def match_ranges(d: Domain) -> DataFrame:
    return search.match_ranges(d.raw("documents"), "The heth", ["doc_id"], "text")


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS t FROM documents),
p AS (SELECT *, instr(lower(t), 'that') AS hit FROM f), s AS (SELECT *, CASE WHEN hit > 0 THEN greatest(0, hit - 1 - 60) ELSE 0 END AS a FROM p)
SELECT doc_id, CASE WHEN length(t) <= 180 THEN t ELSE (CASE WHEN a > 0 THEN '…' ELSE '' END) || trim(substr(t, a + 1, least(length(t), a + 180) - a)) || (CASE WHEN a + 180 < length(t) THEN '…' ELSE '' END) END AS preview FROM s""")  # fmt: skip
def search_preview_plain(d: Domain) -> DataFrame:
    return d.raw("documents").select("doc_id", search.preview(F.col("text"), "That other").alias("preview"))


@query("""WITH g AS (SELECT DISTINCT doc_id, substr(b, p, 3) AS trigram FROM (SELECT doc_id, lower(text) AS b FROM documents), unnest(range(1, length(b) - 1)) AS u(p))
SELECT trigram, count(*) AS df FROM g GROUP BY trigram""")  # fmt: skip
def trigram_postings(d: Domain) -> DataFrame:
    rows = d.raw("documents").select(F.lit(0).alias("kind"), F.col("doc_id").alias("source_id"), F.col("text").alias("body"))
    return search.trigram_postings(rows).groupBy("trigram").agg(F.count(F.lit(1)).alias("df"))


@query(f", {_INDEX} SELECT kind, source_id FROM idx WHERE contains(lower(body), 'license') AND contains(lower(body), 'version')", _TABLES)
def search_by_trigrams(d: Domain) -> DataFrame:
    """Candidates by postings, checked literally."""
    rows = _rows(d)
    found = rows.join(search.trigram_candidates(search.trigram_postings(rows), "license version"), ["kind", "source_id"], "left_semi")
    return found.filter(search.contains_all(F.lower("body"), ["license", "version"])).select("kind", "source_id")


@query("""SELECT b.item_id, d.doc_id, ((length(d.text) - length(replace(d.text, b.text, ''))) / length(b.text))::BIGINT AS n
FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0""")  # fmt: skip
def quote_occurrences(d: Domain) -> DataFrame:
    return anchors.quote_occurrences(d.raw("documents"), d.raw("benchmark").select("item_id", F.col("text").alias("quote")))


def _anchor_rows(d: Domain, start: Column) -> DataFrame:
    """A range of 25 characters of each document, captured; a shorter rest is taken as far as it goes."""
    a, z, prefix, suffix = anchors.capture(F.col("text"), start, start + 25, 16)
    return d.raw("documents").select(F.col("doc_id").alias("article_id"), F.substring("text", a + 1, z - a).alias("quote"), a.cast("long").alias("start_offset"), z.cast("long").alias("end_offset"), prefix.alias("prefix"), suffix.alias("suffix"))


def _anywhere() -> Column:
    """A place in each text, or beyond a short one's end."""
    return F.pmod(F.col("doc_id") * 7919, F.greatest(F.length("text"), F.lit(40))).cast("int")


_ANYWHERE = "doc_id * 7919 % greatest(length(text), 40)"


@query(f"""SELECT doc_id AS article_id, substr(text, a + 1, z - a) AS quote, a AS start_offset, z AS end_offset, substr(text, greatest(a - 16, 0) + 1, least(a, 16)) AS prefix, substr(text, z + 1, 16) AS suffix
FROM (SELECT doc_id, text, least({_ANYWHERE}, length(text)) AS a, least({_ANYWHERE} + 25, length(text)) AS z FROM documents)""")  # fmt: skip
def anchor_capture(d: Domain) -> DataFrame:
    return _anchor_rows(d, _anywhere())


@query(f"SELECT doc_id AS article_id, least({_ANYWHERE}, length(text)) AS new_start, least({_ANYWHERE} + 25, length(text)) AS new_end FROM documents")
def anchor_exact(d: Domain) -> DataFrame:
    articles = d.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return anchors.resolve(_anchor_rows(d, _anywhere()), articles).select("article_id", "new_start", "new_end")


@query("""WITH a AS (SELECT doc_id, doc_id % 20 AS s, substr(text, doc_id % 20 + 1, 25) AS quote, substr(text, greatest(doc_id % 20 - 16, 0) + 1, least(doc_id % 20, 16)) AS prefix,
  substr(text, doc_id % 20 + 26, 16) AS suffix, 'zq' || substr(text, 1, 45) || ' zq ' || text AS t FROM documents WHERE length(text) >= 60),
o AS (SELECT a.*, p - 1 AS p FROM a, unnest(range(1, length(t) - 23)) AS u(p) WHERE substr(t, p, 25) = quote),
c AS (SELECT *, (SELECT count(*) FROM range(1, least(length(prefix), p)::BIGINT + 1) r(k) WHERE right(prefix, k) = substr(t, p - k + 1, k)) AS pre,
  (SELECT count(*) FROM range(1, least(length(suffix), length(t) - p - 25)::BIGINT + 1) r(k) WHERE left(suffix, k) = substr(t, p + 26, k)) AS suf FROM o),
r AS (SELECT doc_id, arg_min(p, row(-(pre + suf), abs(p - s), p)) AS best FROM c GROUP BY doc_id)
SELECT doc_id AS article_id, CASE WHEN substr(t, s + 1, 25) = quote THEN s ELSE best END AS new_start, CASE WHEN substr(t, s + 1, 25) = quote THEN s ELSE best END + 25 AS new_end FROM a LEFT JOIN r USING (doc_id)""")  # fmt: skip
def anchor_best_context(d: Domain) -> DataFrame:
    """The text grew by a copy of its beginning: the right occurrence is told by its context."""
    changed = F.concat(F.lit("zq"), F.substring("text", 1, 45), F.lit(" zq "), F.col("text"))
    articles = d.raw("documents").select(F.col("doc_id").alias("id"), changed.alias("content"))
    rows = _anchor_rows(d, (F.col("doc_id") % 20).cast("int")).join(articles.filter("length(content) >= 110").select(F.col("id").alias("article_id")), "article_id", "left_semi")
    return anchors.resolve(rows, articles).select("article_id", "new_start", "new_end")


@query(r"""WITH r AS (SELECT doc_id, doc_id * 31 % 50 AS lo, substr(text, doc_id * 31 % 50 + 1, 13) AS raw FROM documents),
q AS (SELECT doc_id, lo + length(raw) - length(regexp_replace(raw, '^[ \t\n\x0b\f\r]+', '')) AS a, regexp_replace(raw, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g') AS quote FROM r)
SELECT doc_id, CASE WHEN quote <> '' THEN a END AS "start", CASE WHEN quote <> '' THEN a + length(quote) END AS "end", nullif(quote, '') AS quote FROM q""".replace("\\\\", "\\"))  # fmt: skip
def quotes_of_ranges(d: Domain) -> DataFrame:
    """Ranges given in either order, without white space at their ends."""
    lo = F.pmod(F.col("doc_id") * 31, F.lit(50)).cast("int")
    one, other = F.when(F.col("doc_id") % 2 == 0, lo).otherwise(lo + 13), F.when(F.col("doc_id") % 2 == 0, lo + 13).otherwise(lo)
    q = anchors.quote_from_range(F.col("text"), one, other)
    return d.raw("documents").select("doc_id", q["start"].cast("long").alias("start"), q["end"].cast("long").alias("end"), q["quote"].alias("quote"))


@query("""WITH d AS (SELECT doc_id, text, lower(text) AS b FROM documents), v(t) AS (VALUES ('license'), ('version'), ('public')),
m AS (SELECT doc_id, t, p - 1 AS a, p - 1 + length(t) AS z FROM d JOIN v ON contains(b, t), unnest(range(1, length(b) + 1)) AS u(p) WHERE substr(b, p, length(t)) = t),
w AS (SELECT x.doc_id, x.a, max(y.z) AS z, count(DISTINCT y.t) AS kinds, count(*) AS n FROM m x JOIN m y ON x.doc_id = y.doc_id AND y.a >= x.a AND y.z <= x.a + 34 GROUP BY x.doc_id, x.a),
best AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kinds DESC, n DESC, a) = 1),
s AS (SELECT doc_id, text, greatest(0, least(a - (34 - (z - a)) // 2, length(text) - 34)) AS f FROM best JOIN d USING (doc_id))
SELECT doc_id, CASE WHEN f > 0 THEN '…' ELSE '' END || substr(text, f + 1, 34) || CASE WHEN f + 34 < length(text) THEN '…' ELSE '' END AS snippet FROM s""")  # fmt: skip
def search_snippets(d: Domain) -> DataFrame:
    """Where in each document that has any of three terms the most of them meet."""
    return search.snippets(d.raw("documents"), ["doc_id"], "text", "License version PUBLIC").filter("snippet is not null")


@query("""WITH uses AS (SELECT user_id || ' ' || event_type AS query, epoch_us(ts) AS used_at FROM events)
SELECT query, max(used_at) AS last_used_at, count(*) AS use_count FROM uses GROUP BY query ORDER BY max(used_at) DESC, query LIMIT 30""")  # fmt: skip
def search_history_recent(d: Domain) -> DataFrame:
    from lectern.schema import TABLES

    uses = d.raw("events").select(F.concat_ws(" ", F.col("user_id").cast("string"), "event_type").alias("query"), F.unix_micros(F.col("ts").cast("timestamp")).alias("used_at"), F.lit(1).cast("long").alias("result_count"))
    kept = search.record_history(d.spark.createDataFrame([], TABLES["search_history"]), uses)
    return search.recent_history(kept, 30).select("query", "last_used_at", "use_count")


@query("""WITH uses AS (SELECT user_id || ' ' || event_type AS query, event_type, epoch_us(ts) AS used_at FROM events)
SELECT query, max(used_at) AS last_used_at, count(*) AS use_count FROM uses GROUP BY query HAVING max(event_type) <> 'error'""")  # fmt: skip
def search_history_cleared(d: Domain) -> DataFrame:
    """The history after all searches that ended in an error are forgotten."""
    from lectern.schema import TABLES

    uses = d.raw("events").select(F.concat_ws(" ", F.col("user_id").cast("string"), "event_type").alias("query"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("used_at"), F.lit(1).cast("long").alias("result_count"))
    kept = search.record_history(d.spark.createDataFrame([], TABLES["search_history"]), uses.drop("event_type"))
    bad = uses.filter("event_type = 'error'").select(F.concat(F.lit(" "), F.upper("query")).alias("query"))
    return search.clear_history(kept, bad).select("query", "last_used_at", "use_count")
