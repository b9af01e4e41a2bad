"""Queries over feeds, articles, selections and tags."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.bucketed import ArticleStore
from lectern.operators import feeds as feed_ops
from lectern.operators import library as lib
from lectern.plans.registry import query
from lectern.shared import shared_root
from lectern.sources import payloads
from lectern.sources.domain import CLIP_BASE, EPOCH, Domain
from lectern.streaming import timers

NOW = EPOCH + 3000
POLICY = feed_ops.Policy(disable_after=3)
LATER = EPOCH + 86_400 * 30


@query("SELECT id, url, title, next_fetch, fail_count FROM feeds WHERE NOT disabled AND id <> 0 AND next_fetch <= 1704070200", "feeds")
def due_feeds(d: Domain) -> DataFrame:
    return lib.due_feeds(d.feeds(), NOW).select("id", "url", "title", "next_fetch", "fail_count")


@query("SELECT id, url, title, interval_secs FROM feeds WHERE NOT disabled AND id <> 0", "feeds")
def enabled_feeds(d: Domain) -> DataFrame:
    return lib.enabled_feeds(d.feeds()).select("id", "url", "title", "interval_secs")


@query("SELECT f.id, f.title, (SELECT count(*) FROM articles a WHERE a.feed_id = f.id AND NOT a.is_read AND NOT a.archived) AS unread FROM feeds f WHERE f.id <> 0", "feeds articles")
def feeds_with_unread(d: Domain) -> DataFrame:
    return lib.feeds_with_unread(d.feeds(), d.articles()).select("id", "title", "unread")


@query("SELECT min(next_fetch) AS next_fetch FROM feeds WHERE NOT disabled AND id <> 0", "feeds")
def earliest_next_fetch(d: Domain) -> DataFrame:
    return lib.earliest_next_fetch(d.feeds())


@query("SELECT id, coalesce(title, url) AS title, CASE WHEN disabled THEN 'disabled' WHEN fail_count > 0 THEN 'failing(' || fail_count || ')' ELSE 'ok' END AS status FROM feeds WHERE id <> 0", "feeds")
def feed_status_line(d: Domain) -> DataFrame:
    return lib.feed_status(d.feeds())


def _batch(d: Domain) -> DataFrame:
    """A batch of fetched entries with repeats: every document as it is, and every second one again with changes."""
    i = F.col("doc_id")
    docs = d.raw("documents")
    base = docs.select((F.regexp_extract("source", r"(\d+)$", 1).cast("long") + 1).alias("feed_id"), (i * 2).alias("seq"), F.concat(F.lit("doc:"), (i + 50).cast("string")).alias("entry_id"), F.when(i % 6 != 0, F.concat(F.lit("https://example.com/b/"), i.cast("string"))).alias("url"), F.lit(None).cast("string").alias("title"), F.when(i % 4 == 0, F.lit("A. Writer")).alias("author"), F.when(i % 3 == 0, EPOCH + i).alias("published"), F.when(i % 5 != 0, F.col("text")).alias("content"))
    again = base.filter(i % 2 == 0).withColumns({"seq": F.col("seq") + 1, "title": F.concat(F.lit("new "), "entry_id"), "content": F.when(F.col("seq") % 8 == 0, F.lit("")).otherwise(F.col("content"))})
    return base.unionByName(again)


_BATCH = f"""batch AS (
  SELECT * FROM (
    SELECT regexp_extract(source, '(\\d+)$', 1)::BIGINT + 1 AS feed_id, doc_id * 2 + k AS seq, 'doc:' || (doc_id + 50) AS entry_id,
      CASE WHEN doc_id % 6 <> 0 THEN 'https://example.com/b/' || doc_id END AS url, CASE WHEN k = 1 THEN 'new doc:' || (doc_id + 50) END AS title,
      CASE WHEN doc_id % 4 = 0 THEN 'A. Writer' END AS author, CASE WHEN doc_id % 3 = 0 THEN {EPOCH} + doc_id END AS published,
      CASE WHEN k = 1 AND doc_id % 4 = 0 THEN '' WHEN doc_id % 5 <> 0 THEN text END AS content
    FROM documents, (VALUES (0), (1)) AS t(k) WHERE k = 0 OR doc_id % 2 = 0)),
folded AS (
  SELECT feed_id, entry_id, arg_max(url, seq) FILTER (url IS NOT NULL) AS url, arg_max(title, seq) FILTER (title IS NOT NULL) AS title,
    arg_max(author, seq) FILTER (author IS NOT NULL) AS author, arg_max(published, seq) FILTER (published IS NOT NULL) AS published,
    coalesce(arg_max(content, seq) FILTER (length(content) > 0), arg_min(content, seq)) AS content
  FROM batch GROUP BY feed_id, entry_id)"""


_MERGED = f""", {_BATCH}
SELECT coalesce(a.feed_id, b.feed_id) AS feed_id, coalesce(a.entry_id, b.entry_id) AS entry_id, coalesce(b.url, a.url) AS url, coalesce(b.title, a.title) AS title,
  coalesce(b.author, a.author) AS author, coalesce(b.published, a.published) AS published,
  md5(coalesce(CASE WHEN a.id IS NULL OR length(b.content) > 0 THEN b.content ELSE a.content END, '')) AS content_md5,
  coalesce(a.starred, false) AS starred, coalesce(a.archived, false) AS archived, coalesce(a.fetched_at, {LATER}) AS fetched_at
FROM articles a FULL JOIN folded b ON a.feed_id = b.feed_id AND a.entry_id = b.entry_id"""


def _shown(articles: DataFrame) -> DataFrame:
    return articles.select("feed_id", "entry_id", "url", "title", "author", "published", F.md5(F.coalesce("content", F.lit(""))).alias("content_md5"), "starred", "archived", "fetched_at")


@query(_MERGED, "articles")
def ingest_merge(d: Domain) -> DataFrame:
    return _shown(feed_ops.ingest(d.articles(), _batch(d), LATER))


@query(_MERGED, "articles")
def ingest_merge_bucketed(d: Domain) -> DataFrame:
    """The same merge into stored buckets, in two batches: those of every third feed first."""
    store = ArticleStore(d.spark, f"{shared_root(d.spark)}/articles-{uuid.uuid4().hex[:12]}")
    store.load(d.articles())
    for third in (F.col("feed_id") % 3 == 0, F.col("feed_id") % 3 != 0):
        store.merge(_batch(d).filter(third), LATER)
    return _shown(store.read())


@query(f""", {_BATCH} SELECT feed_id, count(*) AS inserted FROM folded b ANTI JOIN articles a USING (feed_id, entry_id) GROUP BY feed_id""", "articles")
def ingest_inserted_count(d: Domain) -> DataFrame:
    return feed_ops.inserted(d.articles(), _batch(d)).groupBy("feed_id").agg(F.count(F.lit(1)).alias("inserted"))


@query(f""", {_BATCH}, n AS (SELECT feed_id, count(*) AS inserted FROM folded b ANTI JOIN articles a USING (feed_id, entry_id) GROUP BY feed_id)
SELECT count(*) FILTER (inserted > 0) AS feeds, coalesce(sum(inserted), 0)::BIGINT AS articles FROM n""", "articles")  # fmt: skip
def feed_round_totals(d: Domain) -> DataFrame:
    return feed_ops.round_totals(ingest_inserted_count(d))


@query(
    """, r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY feed_id ORDER BY stamp, seq ROWS UNBOUNDED PRECEDING) AS run FROM fetch_log),
g AS (SELECT feed_id, run, count(*) FILTER (NOT ok) AS failures, max(row(stamp, seq)) FILTER (NOT ok) AS failed FROM r GROUP BY feed_id, run)
SELECT feed_id, arg_max(failures, run) AS fail_count, max(failures) AS longest, coalesce(arg_max(failures, failed) FILTER (failed IS NOT NULL), 0) >= 3 AS disabled FROM g GROUP BY feed_id""",
    "fetch_log",
)
def failure_streak_state(d: Domain) -> DataFrame:
    return feed_ops.failure_state(d.fetch_log(), POLICY)


_BACKOFF = f"""SELECT id, fail_count + 1 AS fail_count, least(60 * 2 ** least(fail_count + 1, 16), 3600)::BIGINT AS delay, {NOW} + least(60 * 2 ** least(fail_count + 1, 16), 3600)::BIGINT AS next_fetch,
  fail_count + 1 >= 3 AS disabled FROM feeds WHERE NOT disabled"""


@query(_BACKOFF, "feeds")
def due_backoff_schedule(d: Domain) -> DataFrame:
    return feed_ops.backoff_schedule(d.feeds(), NOW, POLICY)


@query(_BACKOFF, "feeds")
def due_backoff_by_timer(d: Domain) -> DataFrame:
    """The same schedule from a stream: each feed fails once, its timer is set, and expires; only what its timer (or the
    disabled mark) confirms is shown."""
    root = f"{shared_root(d.spark)}/polling-{uuid.uuid4().hex[:12]}"
    known = timers.listed(d.feeds(), NOW - 1)
    failed = known.withColumns({"at": F.lit(NOW).cast("long"), "kind": F.lit("failed")})
    known.unionByName(failed).write.parquet(f"{root}/events")
    timers.start_polling(d.spark.readStream.schema(timers.EVENT).parquet(f"{root}/events"), f"{root}/log", f"{root}/checkpoint", POLICY, once=True).awaitTermination()
    log = d.spark.read.schema(timers.LOG).parquet(f"{root}/log")
    due = log.filter("what = 'due'").select("feed_id", "at")
    confirmed = log.filter("what = 'scheduled'").join(due, ["feed_id", "at"], "left_semi").unionByName(log.filter("what = 'stopped'").select("feed_id", "at", "what", "fail_count", "disabled"))
    return confirmed.select(F.col("feed_id").alias("id"), "fail_count", (F.col("at") - NOW).alias("delay"), F.col("at").alias("next_fetch"), "disabled")


@query(f"""SELECT id, coalesce(title, 'Fetched ' || id) AS title, CASE WHEN id % 2 = 0 THEN {NOW} END AS last_fetch,
  CASE WHEN id % 2 = 0 THEN {NOW} + coalesce(interval_secs, 900) ELSE {NOW} + least(60 * 2 ** (fail_count + 1), 3600)::BIGINT END AS next_fetch,
  CASE WHEN id % 2 = 0 THEN 0 ELSE fail_count + 1 END AS fail_count, CASE WHEN id % 2 = 1 THEN 'HTTP 503' END AS last_error,
  CASE WHEN id % 2 = 0 THEN disabled ELSE fail_count + 1 >= 3 END AS disabled
FROM feeds WHERE id <> 0 AND id % 2 = 0 UNION ALL
SELECT id, title, NULL, {NOW} + least(60 * 2 ** (fail_count + 1), 3600)::BIGINT, fail_count + 1, 'HTTP 503', fail_count + 1 >= 3 FROM feeds WHERE id <> 0 AND id % 2 = 1""", "feeds")  # fmt: skip
def record_round(d: Domain) -> DataFrame:
    """Even feeds were fetched, odd ones failed."""
    feeds = d.feeds().filter("id <> 0")
    good = feeds.filter("id % 2 = 0").select(F.col("id").alias("feed_id"), F.concat(F.lit("Fetched "), F.col("id").cast("string")).alias("title"))
    bad = feeds.filter("id % 2 = 1").select(F.col("id").alias("feed_id"), F.lit("HTTP 503").alias("error"))
    after = feed_ops.record_failure(feed_ops.record_success(feeds, good, NOW, POLICY), bad, NOW, POLICY)
    return after.select("id", "title", "last_fetch", "next_fetch", "fail_count", "last_error", "disabled")


@query(
    """, gone AS (SELECT id FROM feeds WHERE id = 3), dead AS (SELECT a.id FROM articles a JOIN gone ON a.feed_id = gone.id)
SELECT 'feeds' AS part, count(*) AS n FROM feeds WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'articles', count(*) FROM articles WHERE id NOT IN (SELECT id FROM dead)
UNION ALL SELECT 'article_selections', count(*) FROM selections WHERE article_id NOT IN (SELECT id FROM dead)
UNION ALL SELECT 'article_tags', count(*) FROM article_tags WHERE article_id NOT IN (SELECT id FROM dead)""",
    "feeds articles selections article_tags",
)
def remove_feed_cascade(d: Domain) -> DataFrame:
    left = lib.remove_feed(3, d.feeds(), d.articles(), d.selections(), d.article_tags())
    out = None
    for name, df in left.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def _brief(df: DataFrame) -> DataFrame:
    return df.select("id", "feed_id", "title", F.coalesce("published", "fetched_at").alias("shown_at"), "is_read", "starred")


_BRIEF = "id, feed_id, title, coalesce(published, fetched_at) AS shown_at, is_read, starred"


@query(f"SELECT {_BRIEF} FROM articles WHERE feed_id = 2 AND NOT archived", "articles")
def articles_for_feed(d: Domain) -> DataFrame:
    return _brief(lib.content_mode("feed", d.articles(), d.feeds(), 2))


@query(f"SELECT {_BRIEF} FROM articles WHERE NOT archived AND (starred OR feed_id = 0)", "articles")
def saved_articles(d: Domain) -> DataFrame:
    return _brief(lib.content_mode("saved", d.articles(), d.feeds()))


@query("SELECT count(*) AS n FROM articles WHERE NOT archived AND (starred OR feed_id = 0)", "articles")
def saved_article_count(d: Domain) -> DataFrame:
    return lib.saved_articles(d.articles(), d.feeds()).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_BRIEF} FROM articles WHERE NOT archived AND read_later", "articles")
def read_later_articles(d: Domain) -> DataFrame:
    return _brief(lib.content_mode("read-later", d.articles(), d.feeds()))


@query(f"SELECT {_BRIEF} FROM articles WHERE archived", "articles")
def archived_articles(d: Domain) -> DataFrame:
    return _brief(lib.archived_articles(d.articles()))


@query("SELECT id, url, coalesce(published, fetched_at) AS shown_at, length(content) AS size FROM articles WHERE feed_id = 0", "articles")
def web_clippings(d: Domain) -> DataFrame:
    return lib.web_clippings(d.articles(), d.feeds()).select("id", "url", F.coalesce("published", "fetched_at").alias("shown_at"), F.length("content").cast("long").alias("size"))


@query("""SELECT count(*) FILTER (NOT archived AND (starred OR feed_id = 0)) AS saved, count(*) FILTER (NOT archived AND read_later) AS read_later,
  count(*) FILTER (archived) AS archived, count(*) FILTER (feed_id = 0) AS clippings, count(*) FILTER (NOT archived AND NOT is_read) AS unread FROM articles""", "articles")  # fmt: skip
def library_counts(d: Domain) -> DataFrame:
    return lib.library_counts(d.articles(), d.feeds())


@query("""SELECT s.id, s.article_id, a.feed_id, a.title AS article_title, s.is_favorite, s.updated_at FROM selections s JOIN articles a ON a.id = s.article_id
WHERE s.is_favorite OR (s.comment IS NOT NULL AND length(trim(s.comment)) > 0)""", "articles selections")  # fmt: skip
def saved_selections(d: Domain) -> DataFrame:
    return lib.saved_selections(d.selections(), d.articles()).select("id", "article_id", "feed_id", "article_title", "is_favorite", "updated_at")


@query("SELECT id, article_id, md5(selected_text) AS text_md5, updated_at FROM selections WHERE is_favorite", "selections")
def favorite_selections(d: Domain) -> DataFrame:
    return lib.favorite_selections(d.selections()).select("id", "article_id", F.md5("selected_text").alias("text_md5"), "updated_at")


@query("SELECT id, is_favorite, created_at FROM selections WHERE article_id = 7", "selections")
def selections_for_article(d: Domain) -> DataFrame:
    return lib.selections_for_article(d.selections(), 7).select("id", "is_favorite", "created_at")


@query("""SELECT count(*) FILTER (is_favorite OR (comment IS NOT NULL AND length(trim(comment)) > 0)) AS saved, count(*) FILTER (is_favorite) AS favorites,
  count(*) FILTER (comment IS NOT NULL AND length(trim(comment)) > 0) AS thoughts FROM selections""", "selections")  # fmt: skip
def selection_counts(d: Domain) -> DataFrame:
    return lib.selection_counts(d.selections())


@query("SELECT l.article_id, t.id, t.name FROM article_tags l JOIN tags t ON t.id = l.tag_id", "article_tags tags")
def tags_for_article(d: Domain) -> DataFrame:
    return lib.tags_for_article(d.article_tags(), d.tags())


@query("SELECT article_id, lower(trim(name)) AS key, max(trim(name)) AS name FROM tag_names GROUP BY article_id, lower(trim(name))", "tag_names")
def tag_normalize_replace(d: Domain) -> DataFrame:
    return lib.normalize_tags(d.tag_names()).select("article_id", "key", "name")


@query("SELECT t.id, t.name FROM tags t WHERE NOT EXISTS (SELECT 1 FROM article_tags l WHERE l.tag_id = t.id AND l.article_id % 10 = 1)", "article_tags tags")
def orphan_tags(d: Domain) -> DataFrame:
    return lib.orphan_tags(d.tags(), d.article_tags().filter("article_id % 10 = 1")).select("id", "name")


@query("""SELECT 'archive' AS action, count(*) FILTER (archived OR id % 11 = 0) AS n FROM articles UNION ALL
SELECT 'bookmark', count(*) FILTER (starred OR id % 11 = 0) FROM articles UNION ALL SELECT 'read-later', count(*) FILTER (read_later OR id % 11 = 0) FROM articles""", "articles")  # fmt: skip
def batch_action(d: Domain) -> DataFrame:
    articles = d.articles().select("id", "archived", "starred", "read_later")
    ids = articles.filter("id % 11 = 0").select("id")
    parts = [lib.apply_batch(articles, ids, a).agg(F.lit(a).alias("action"), F.count_if(f).alias("n")) for a, f in (("archive", "archived"), ("bookmark", "starred"), ("read-later", "read_later"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT id, CASE WHEN id % 13 = 0 THEN NOT starred ELSE starred END AS starred FROM articles", "articles")
def toggle_star(d: Domain) -> DataFrame:
    articles = d.articles().select("id", "starred")
    return lib.set_flag(articles, articles.filter("id % 13 = 0").select("id"), "starred", None)


@query("SELECT id, is_read OR id % 4 = 0 AS is_read FROM articles", "articles")
def mark_read(d: Domain) -> DataFrame:
    articles = d.articles().select("id", "is_read")
    return lib.set_flag(articles, articles.filter("id % 4 = 0").select("id"), "is_read", True)


@query(f"SELECT id, disabled AND id <> 7 AS disabled, CASE WHEN id = 7 THEN 0 ELSE fail_count END AS fail_count, CASE WHEN id = 7 THEN {NOW} ELSE next_fetch END AS next_fetch, CASE WHEN id = 5 THEN 120 ELSE interval_secs END AS interval_secs FROM feeds WHERE id <> 0", "feeds")
def feed_settings(d: Domain) -> DataFrame:
    feeds = lib.set_interval(lib.set_disabled(d.feeds(), 7, False, NOW), 5, 120)
    return feeds.filter("id <> 0").select("id", "disabled", "fail_count", "next_fetch", "interval_secs")


@query(f"SELECT id, url FROM feeds UNION ALL SELECT (SELECT max(id) FROM feeds) + row_number() OVER (ORDER BY url), url FROM (SELECT DISTINCT url FROM pages WHERE page_id < {CLIP_BASE})", "feeds")
def add_feeds(d: Domain) -> DataFrame:
    known = d.feeds()
    wanted = d.raw("pages").select("url").unionByName(known.select("url"))
    return lib.add_feed(known, wanted, NOW).select("id", "url")


@query("""WITH e AS (SELECT doc_id AS seq, CASE doc_id % 3 WHEN 0 THEN '' WHEN 2 THEN 'e' || doc_id END AS id, CASE WHEN doc_id % 4 <> 0 THEN 'T' || doc_id END AS title, CASE WHEN doc_id % 7 <> 0 THEN text END AS content,
  CASE WHEN doc_id % 2 = 0 THEN 'sum ' || doc_id END AS summary, CASE WHEN doc_id % 5 <> 1 THEN 'http://l/' || doc_id END AS alternate, CASE WHEN doc_id % 6 = 0 THEN 'http://p/' || doc_id || '.png' END AS picture, CASE WHEN doc_id % 5 = 0 THEN 'http://t/' || doc_id END AS thumb FROM documents),
b AS (SELECT *, CASE WHEN content IS NULL AND summary IS NULL AND picture IS NULL AND thumb IS NULL THEN NULL ELSE coalesce(content, summary, '') || coalesce(chr(10) || '<img src="' || thumb || '">', '') || coalesce(chr(10) || '<img src="' || picture || '">', '') END AS body FROM e)
SELECT seq, coalesce(nullif(id, ''), alternate, 'http://s/' || seq, title, '') AS entry_id, coalesce(alternate, 'http://s/' || seq) AS url, title, 'Ann' AS author, md5(coalesce(body, '')) AS content_md5, body IS NULL AS empty FROM b""")  # fmt: skip
def normalised_entries(d: Domain) -> DataFrame:
    """Entries of every mixture: empty and missing ids, titles, bodies, an alternate link, pictures."""
    i, t = F.col("doc_id"), F.col("doc_id").cast("string")
    link = lambda href, rel, kind: F.struct(href.alias("href"), F.lit(rel).cast("string").alias("rel"), F.lit(kind).cast("string").alias("media_type"))
    links = F.filter(F.array(F.when(i >= 0, link(F.concat(F.lit("http://s/"), t), "self", None)), F.when(i % 5 != 1, link(F.concat(F.lit("http://l/"), t), "alternate", None)), F.when(i % 6 == 0, link(F.concat(F.lit("http://p/"), t, F.lit(".png")), "enclosure", "image/png"))), lambda x: x.isNotNull())
    entries = d.raw("documents").select(
        F.lit(1).cast("long").alias("feed_id"), i.alias("seq"), F.when(i % 3 == 0, "").when(i % 3 == 2, F.concat(F.lit("e"), t)).alias("id"), F.when(i % 4 != 0, F.concat(F.lit("T"), t)).alias("title"), F.lit(None).cast("long").alias("updated"), i.alias("published"),
        F.when(i % 7 != 0, F.col("text")).alias("content"), F.when(i % 2 == 0, F.concat(F.lit("sum "), t)).alias("summary"), F.array(F.lit("Ann"), F.lit("Bob")).alias("authors"), links.alias("links"), F.when(i % 5 == 0, F.array(F.concat(F.lit("http://t/"), t))).alias("thumbnails"),
        F.lit(None).cast("array<struct<url:string,type:string>>").alias("media"),
    )
    out = feed_ops.entry_to_article(entries)
    return out.select("seq", "entry_id", "url", "title", "author", F.md5(F.coalesce("content", F.lit(""))).alias("content_md5"), F.col("content").isNull().alias("empty"))


@query("SELECT id, title, disabled OR id = 0 AS disabled, CASE WHEN id <> 0 THEN last_error END AS last_error, CASE WHEN id <> 0 THEN fail_count ELSE 0 END AS fail_count FROM feeds", "feeds")
def clippings_feed(d: Domain) -> DataFrame:
    """The hidden feed, enabled by mistake and with a failure, is put right."""
    hidden = F.col("id") == 0
    wrong = d.feeds().withColumns({"disabled": F.col("disabled") & ~hidden, "title": F.when(hidden, "other").otherwise(F.col("title")), "fail_count": F.when(hidden, 3).otherwise(F.col("fail_count")), "last_error": F.when(hidden, "x").otherwise(F.col("last_error"))})
    return lib.ensure_clippings_feed(wrong, NOW).select("id", "title", "disabled", "last_error", "fail_count")


@query(f""", top AS (SELECT max(id) AS top FROM articles), new AS (SELECT url, html, row_number() OVER (ORDER BY url, html) AS n FROM pages WHERE page_id % 10 <> 0)
SELECT id, feed_id, url, content, author, published, is_read, starred FROM (SELECT top + n AS id, 0 AS feed_id, url, md5(html) AS content, 'Web clippings' AS author, {LATER} AS published, true AS is_read, true AS starred FROM new, top)""", "articles")  # fmt: skip
def saved_clippings(d: Domain) -> DataFrame:
    """All pages saved once more; every tenth is blank and refused."""
    before = d.articles()
    pages = d.raw("pages").select(F.concat(F.lit(" "), "url").alias("url"), F.lit(" ").alias("title"), F.when(F.col("page_id") % 10 == 0, F.lit(" \n")).otherwise(F.col("html")).alias("html"))
    after = lib.save_clippings(before, d.feeds(), pages, LATER)
    new = after.join(before.select("id"), "id", "left_anti")
    return new.select("id", "feed_id", "url", F.md5("content").alias("content"), "author", "published", "is_read", "starred")


@query(f"SELECT feed_id, count(*) AS n FROM articles WHERE id <> {CLIP_BASE + 1} GROUP BY feed_id", "articles")
def delete_clipping(d: Domain) -> DataFrame:
    """A clipping goes; an article of another feed stays."""
    left = lib.delete_clipping(lib.delete_clipping(d.articles(), d.feeds(), CLIP_BASE + 1), d.feeds(), 7)
    return left.groupBy("feed_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, CASE WHEN id % 4 = 0 THEN 'blank text' WHEN id % 4 = 1 THEN 'bad offsets' WHEN id % 4 = 2 AND comment IS NULL THEN 'blank comment' END AS error,
  CASE WHEN id % 4 = 0 THEN '' ELSE regexp_replace(selected_text, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') END AS selected_text FROM selections""", "selections")  # fmt: skip
def selections_checked(d: Domain) -> DataFrame:
    i = F.col("id")
    text = F.when(i % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "selected_text", F.lit("\n")))
    rows = d.selections().select("id", text.alias("selected_text"), F.lit(5).cast("long").alias("start_offset"), F.when(i % 4 == 1, 3).otherwise(9).cast("long").alias("end_offset"), "comment", (i % 4 == 2).alias("needs_comment"))
    return lib.check_selections(rows).select("id", "error", "selected_text")


@query(f"""SELECT id, CASE WHEN id = 100 THEN 'noted' WHEN id = 101 THEN NULL ELSE comment END AS comment, CASE WHEN id = 102 THEN NOT is_favorite ELSE is_favorite END AS is_favorite,
  CASE WHEN id IN (100, 101, 102) THEN {NOW} ELSE updated_at END AS updated_at FROM selections WHERE id <> 103""", "selections")  # fmt: skip
def selections_changed(d: Domain) -> DataFrame:
    rows = lib.update_selection(d.selections(), 100, NOW, comment=" noted ")
    rows = lib.update_selection(lib.update_selection(rows, 101, NOW, comment="  "), 102, NOW, toggle=True)
    return lib.delete_selection(rows, 103).select("id", "comment", "is_favorite", "updated_at")


@query("SELECT doc_id AS article_id, CASE WHEN doc_id % 3 = 0 THEN 'new ' || doc_id ELSE 'old ' || doc_id END AS summary_zh, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS updated_at FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def article_ai_upsert(d: Domain) -> DataFrame:
    made = lambda keep, word, at: d.raw("documents").filter(keep).select(F.col("doc_id").alias("article_id"), F.concat(F.lit(word), F.col("doc_id").cast("string")).alias("summary_zh"), F.lit("t").alias("translation_zh"), F.lit("m").alias("model"), F.lit(at).cast("long").alias("updated_at"))
    return lib.save_article_ai(made("doc_id % 2 = 0", "old ", 1), made("doc_id % 3 = 0", "new ", 2)).select("article_id", "summary_zh", "updated_at")


@query("SELECT id, feed_id, entry_id FROM articles WHERE id = 7", "articles")
def article_lookup(d: Domain) -> DataFrame:
    return lib.article(d.articles(), 7).select("id", "feed_id", "entry_id")


@query("SELECT id, url, title FROM feeds WHERE id = 2 UNION ALL SELECT id, url, title FROM feeds WHERE url = (SELECT url FROM feeds WHERE id = 3)", "feeds")
def feed_lookup(d: Domain) -> DataFrame:
    by_url = d.feeds().join(lib.feed(d.feeds(), 3).select("url"), "url", "left_semi")
    return lib.feed(d.feeds(), "2").unionByName(by_url.select(*d.feeds().columns)).select("id", "url", "title")


@query("""SELECT doc_id, list_filter(list_transform([lang, 'x ' || doc_id, '', source], lambda v: trim(v)), lambda v: length(v) > 0) AS names FROM documents""")
def tag_drafts(d: Domain) -> DataFrame:
    draft = F.concat("lang", F.lit(" ,  x "), F.col("doc_id").cast("string"), F.lit("， \n"), "source", F.lit(","))
    return d.raw("documents").select("doc_id", lib.split_tag_draft(draft).alias("names"))


_NAMED = "CASE WHEN doc_id % 4 = 1 AND regexp_full_match(coalesce(text, ''), '(?s)[\\x00-\\x7F\\x{A0}-\\x{FF}]*') THEN 'ISO-8859-1' WHEN doc_id % 4 = 2 THEN 'UTF-16LE' WHEN doc_id % 4 = 3 THEN 'UTF-16' ELSE 'UTF-8' END"


@query(f"""SELECT doc_id, {_NAMED} AS encoding, md5('<?xml version="1.0" encoding="' || {_NAMED} || '"?><t>' || coalesce(text, '') || '</t>') AS payload_md5 FROM documents""")
def feed_bodies_decoded(d: Domain) -> DataFrame:
    """Each document as the body of a feed in one of four encodings (the third without a mark), decoded by what it declares."""
    text, i = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    latin = (i == 1) & text.rlike(r"^[\x00-\x7F\xA0-\xFF]*$")
    name = F.when(latin, "ISO-8859-1").when(i == 2, "UTF-16LE").when(i == 3, "UTF-16").otherwise("UTF-8")
    xml = F.concat(F.lit('<?xml version="1.0" encoding="'), name, F.lit('"?><t>'), text, F.lit("</t>"))
    body = F.when(latin, F.encode(F.when(latin, xml), "ISO-8859-1")).when(i == 2, F.encode(xml, "UTF-16LE")).when(i == 3, F.encode(xml, "UTF-16")).otherwise(F.encode(xml, "UTF-8"))
    sent = d.raw("documents").select("doc_id", name.alias("encoding"), body.alias("body"), F.lit("application/rss+xml").alias("content_type"))
    return payloads.decoded_feeds(sent).select("doc_id", "encoding", F.md5("payload").alias("payload_md5"))
