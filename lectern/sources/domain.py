"""The library's tables as deterministic projections of the synthetic tables, and the same projections in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.schema import CLIPPINGS_TITLE, CLIPPINGS_URL, conform

EPOCH = 1704067200
CLIP_BASE = 10_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(column: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(column, F.lit(len(values))) + 1).cast("int"))


class Domain:
    """Lazily built library tables over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return read(self.spark, self.dir, name)

    def feeds(self) -> DataFrame:
        """One feed for each source of documents, and the hidden feed."""
        rows = self.raw("documents").select("source").distinct().withColumn("id", F.regexp_extract("source", r"(\d+)$", 1).cast("long") + 1)
        i = F.col("id")
        rows = rows.select(
            i,
            F.concat(F.lit("https://"), "source", F.lit(".example/feed")).alias("url"),
            F.when(i % 5 != 0, F.concat(F.lit("Feed "), i.cast("string"))).alias("title"),
            F.when(i % 3 != 0, 600 * i).alias("interval_secs"),
            F.lit(None).cast("long").alias("last_fetch"),
            (EPOCH + 300 * i).alias("next_fetch"),
            F.when(i % 4 != 0, F.lit("timeout")).alias("last_error"),
            (i % 4).alias("fail_count"),
            (i % 7 == 0).alias("disabled"),
        )
        hidden = self.spark.range(1).select(F.lit(0).cast("long").alias("id"), F.lit(CLIPPINGS_URL).alias("url"), F.lit(CLIPPINGS_TITLE).alias("title"), F.lit(True).alias("disabled"))
        return conform(rows, "feeds").unionByName(conform(hidden, "feeds"))

    def feed_articles(self) -> DataFrame:
        """Without labels."""
        d = F.col("doc_id")
        return conform(
            self.raw("documents").select(
                d.alias("id"),
                (F.regexp_extract("source", r"(\d+)$", 1).cast("long") + 1).alias("feed_id"),
                F.concat(F.lit("doc:"), d.cast("string")).alias("entry_id"),
                F.when(d % 4 != 0, F.concat(F.lit("https://example.com/a/"), d.cast("string"))).alias("url"),
                F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
                F.when(d % 5 != 0, EPOCH + 60 * d).alias("published"),
                F.col("text").alias("content"),
                (d % 3 == 0).alias("is_read"),
                (d % 7 == 0).alias("read_later"),
                (EPOCH + 60 * d + 3600).alias("fetched_at"),
            ),
            "articles",
        )

    def clippings(self) -> DataFrame:
        p = F.col("page_id")
        return conform(
            self.raw("pages").select(
                (CLIP_BASE + p).alias("id"), F.lit(0).cast("long").alias("feed_id"), F.concat(F.lit("clip:"), p.cast("string")).alias("entry_id"), "url", F.lit(CLIPPINGS_TITLE).alias("author"),
                (EPOCH + p).alias("published"), F.col("html").alias("content"), F.lit(True).alias("is_read"), F.lit(True).alias("starred"), (EPOCH + p).alias("fetched_at"),
            ),
            "articles",
        )

    def articles(self) -> DataFrame:
        """Labels meet all articles by id, so that a later join by id finds their texts where this one has dealt them; titles are
        made before, so that who needs no more sends no texts."""
        rows = self.feed_articles().unionByName(self.clippings())
        own = (F.col("id") == F.col("doc_id")) & F.col("entry_id").startswith("doc:")
        marked = rows.join(self.raw("labels").select("doc_id", "quality", "toxic"), own, "left")
        return conform(marked.withColumns({"starred": F.col("starred") | (F.coalesce("quality", F.lit(0)) == 1), "archived": F.coalesce("toxic", F.lit(0)) == 1}), "articles")

    def selections(self) -> DataFrame:
        i = F.col("conv_id") * 100 + F.col("turn")
        user = F.col("role") == "user"
        return conform(
            self.raw("conversations").select(
                i.alias("id"), F.col("conv_id").alias("article_id"), F.when(user, F.col("text")).otherwise(F.lit("a marked passage")).alias("selected_text"),
                F.when(~user, F.col("text")).alias("comment"), user.alias("is_favorite"), (EPOCH + i).alias("created_at"), (EPOCH + i).alias("updated_at"),
            ),
            "article_selections",
        )

    def tag_names(self) -> DataFrame:
        """(article_id, name) as a user might type them: language, source, and the language again in capitals."""
        names = F.array("lang", F.concat(F.lit("Source"), F.regexp_extract("source", r"(\d+)$", 1)), F.upper("lang"))
        return self.raw("documents").select(F.col("doc_id").alias("article_id"), F.explode(names).alias("name"))

    def tags(self) -> DataFrame:
        """One tag for each name without regard to case, spelt as it sorts first; ids by name."""
        from pyspark.sql.window import Window

        rows = self.tag_names().groupBy(F.lower("name").alias("key")).agg(F.max("name").alias("name"))
        # a few dozen names: one small window partition
        return rows.select(F.row_number().over(Window.orderBy("key")).cast("long").alias("id"), "name", F.lit(EPOCH).cast("long").alias("created_at"))

    def article_tags(self) -> DataFrame:
        links = self.tag_names().select("article_id", F.lower("name").alias("key")).distinct()
        tags = self.tags().select(F.col("id").alias("tag_id"), F.lower("name").alias("key"))
        return links.join(F.broadcast(tags), "key").select("article_id", "tag_id", F.lit(EPOCH).cast("long").alias("created_at"))

    def resources(self) -> DataFrame:
        p = F.col("page_id")
        return conform(
            self.raw("pages").select(
                p.alias("id"), "url", F.col("url").alias("canonical_url"), F.when(p % 10 == 9, CLIP_BASE + p).alias("linked_article_id"), _pick(p, ["site", "page", "article"]).alias("kind"),
                F.when(p % 6 != 0, F.concat(F.lit("Page "), p.cast("string"))).alias("title"),
                F.when(p % 3 != 0, F.concat(F.lit("Guide "), (p % 17).cast("string"))).alias("purpose_zh"), F.when(p % 3 == 1, F.lit("manual")).when(p % 3 == 2, F.lit("ai")).alias("purpose_source"),
                F.when(p % 2 == 0, F.concat(F.lit("when reading "), (p % 11).cast("string"))).alias("use_when_zh"),
                F.array(F.concat(F.lit("cap"), (p % 5).cast("string"))).alias("capabilities"), F.array().cast("array<string>").alias("limitations"), F.array(F.lit("en")).alias("languages"),
                F.when(p % 9 == 0, F.lit("private")).otherwise(F.lit("public")).alias("privacy"),
                _pick(p, ["active", "pending_review", "enrichment_pending", "broken", "archived"]).alias("status"), _pick(p, ["gui", "cli_agent", "import"]).alias("source"),
                F.when(p % 4 != 0, 1 + p % 5).alias("manual_rating"), (EPOCH + p).alias("created_at"), (EPOCH + p).alias("updated_at"),
            ),
            "resources",
        )

    def fetch_log(self) -> DataFrame:
        """Fetch attempts: an error event is a failure."""
        return self.raw("events").select(F.col("user_id").cast("long").alias("feed_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("seq"), (F.col("event_type") != "error").alias("ok"))


#: The same tables as DuckDB expressions.
SQL = {
    "feeds": f"""SELECT id, 'https://' || source || '.example/feed' AS url, CASE WHEN id % 5 <> 0 THEN 'Feed ' || id END AS title,
  CASE WHEN id % 3 <> 0 THEN 600 * id END AS interval_secs, NULL::BIGINT AS last_fetch, {EPOCH} + 300 * id AS next_fetch,
  CASE WHEN id % 4 <> 0 THEN 'timeout' END AS last_error, id % 4 AS fail_count, id % 7 = 0 AS disabled
  FROM (SELECT DISTINCT source, regexp_extract(source, '(\\d+)$', 1)::BIGINT + 1 AS id FROM documents)
  UNION ALL SELECT 0, '{CLIPPINGS_URL}', '{CLIPPINGS_TITLE}', NULL, NULL, 0, NULL, 0, true""",
    "articles": f"""SELECT doc_id AS id, regexp_extract(source, '(\\d+)$', 1)::BIGINT + 1 AS feed_id, 'doc:' || doc_id AS entry_id,
  CASE WHEN doc_id % 4 <> 0 THEN 'https://example.com/a/' || doc_id END AS url, split_part(text, chr(10), 1) AS title, NULL AS author,
  CASE WHEN doc_id % 5 <> 0 THEN {EPOCH} + 60 * doc_id END AS published, text AS content, doc_id % 3 = 0 AS is_read,
  coalesce(quality, 0) = 1 AS starred, doc_id % 7 = 0 AS read_later, coalesce(toxic, 0) = 1 AS archived, {EPOCH} + 60 * doc_id + 3600 AS fetched_at
  FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL SELECT {CLIP_BASE} + page_id, 0, 'clip:' || page_id, url, NULL, '{CLIPPINGS_TITLE}', {EPOCH} + page_id, html, true, true, false, false, {EPOCH} + page_id FROM pages""",
    "selections": f"""SELECT id, conv_id AS article_id, CASE WHEN role = 'user' THEN text ELSE 'a marked passage' END AS selected_text,
  CASE WHEN role <> 'user' THEN text END AS comment, role = 'user' AS is_favorite, {EPOCH} + id AS created_at, {EPOCH} + id AS updated_at
  FROM (SELECT *, conv_id * 100 + turn AS id FROM conversations)""",
    "tag_names": """SELECT doc_id AS article_id, unnest([lang, 'Source' || regexp_extract(source, '(\\d+)$', 1), upper(lang)]) AS name FROM documents""",
    "tags": """SELECT row_number() OVER (ORDER BY lower(name)) AS id, max(name) AS name FROM tag_names GROUP BY lower(name)""",
    "article_tags": """SELECT DISTINCT n.article_id, t.id AS tag_id FROM tag_names n JOIN tags t ON lower(n.name) = lower(t.name)""",
    "resources": f"""SELECT page_id AS id, url, url AS canonical_url, CASE WHEN page_id % 10 = 9 THEN {CLIP_BASE} + page_id END AS linked_article_id,
  CASE WHEN page_id % 6 <> 0 THEN 'Page ' || page_id END AS title, CASE WHEN page_id % 3 <> 0 THEN 'Guide ' || page_id % 17 END AS purpose_zh,
  CASE page_id % 3 WHEN 1 THEN 'manual' WHEN 2 THEN 'ai' END AS purpose_source,
  CASE WHEN page_id % 2 = 0 THEN 'when reading ' || page_id % 11 END AS use_when_zh, 'cap' || page_id % 5 AS capability,
  CASE WHEN page_id % 9 = 0 THEN 'private' ELSE 'public' END AS privacy,
  (['active', 'pending_review', 'enrichment_pending', 'broken', 'archived'])[page_id % 5 + 1] AS status, (['gui', 'cli_agent', 'import'])[page_id % 3 + 1] AS source,
  CASE WHEN page_id % 4 <> 0 THEN 1 + page_id % 5 END AS manual_rating, {EPOCH} + page_id AS created_at, {EPOCH} + page_id AS updated_at FROM pages""",
    "fetch_log": """SELECT user_id::BIGINT AS feed_id, epoch_us(ts) AS stamp, event_id::BIGINT AS seq, event_type <> 'error' AS ok FROM events""",
}

_NEEDS = {"tags": ["tag_names"], "article_tags": ["tag_names", "tags"]}


def with_tables(*names: str, body: str) -> str:
    """A query over the named library tables."""
    order: list[str] = []
    for n in names:
        for x in (*_NEEDS.get(n, ()), n):
            if x not in order:
                order.append(x)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + body
