"""Queries over the resource catalogue and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import scalars, urls
from lectern.operators import enrichment as enrich
from lectern.operators import resources as res
from lectern.plans.registry import query
from lectern.schema import TABLES, TRANSITIONS
from lectern.sources.domain import EPOCH, Domain

_CANON = r"""CASE WHEN regexp_matches(url, '(?i)^https?://[^/?#:@]+') THEN
  lower(regexp_extract(url, '(?i)^(https?://[^/?#:@]+)', 1)) || CASE WHEN regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1) END
  || regexp_extract(url, '^[^?#]*(\?[^#]*)?', 1) END"""


@query(f"SELECT page_id AS id, {_CANON} AS canonical_url FROM pages")
def canonical_urls(d: Domain) -> DataFrame:
    return d.raw("pages").select(F.col("page_id").alias("id"), urls.canonical(F.col("url")).alias("canonical_url"))


@query(f"WITH c AS (SELECT page_id AS id, {_CANON} AS canonical FROM (SELECT page_id, regexp_replace(url, '[0-9]+.*$', '') AS url FROM pages)) SELECT canonical, min(id) AS id, count(*) AS copies FROM c WHERE canonical IS NOT NULL GROUP BY canonical")
def resource_dedup(d: Domain) -> DataFrame:
    """Addresses cut before their number, so that many are equal."""
    rows = d.raw("pages").select(F.col("page_id").alias("id"), F.regexp_replace("url", "[0-9]+.*$", "").alias("url"))
    return res.first_by_address(rows)


@query(f"""WITH n AS (SELECT page_id AS seq, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://new.example/' || page_id % 40 END AS url, CASE WHEN page_id % 50 = 7 THEN 9 ELSE 3 END AS rating FROM pages),
c AS (SELECT *, {_CANON} AS canonical FROM n), ok AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY seq) AS k FROM c WHERE rating <= 5)
SELECT seq, CASE WHEN c.rating > 5 THEN 'bad rating' WHEN c.canonical IN (SELECT url FROM pages) OR ok.k > 1 THEN 'duplicate' END AS error FROM c LEFT JOIN ok USING (seq)""")  # fmt: skip
def resource_create(d: Domain) -> DataFrame:
    """A batch in which even rows are known addresses and odd ones repeat."""
    p = F.col("page_id")
    new = d.raw("pages").select(p.alias("seq"), F.when(p % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("https://new.example/"), (p % 40).cast("string"))).alias("url"), F.lit("page").alias("kind"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("private_note"), F.lit("public").alias("privacy"), F.lit("gui").alias("source"), F.when(p % 50 == 7, 9).otherwise(3).cast("long").alias("manual_rating"))
    resources = d.resources().withColumn("canonical_url", F.col("url"))
    after, rejects = res.create(resources, new, EPOCH)
    made = after.join(resources.select("id"), "id", "left_anti").select(F.col("url"))
    wrong = rejects.select("seq", "error")
    good = new.join(wrong.select("seq"), "seq", "left_anti").join(made, "url", "left_semi").select("seq", F.lit(None).cast("string").alias("error"))
    return wrong.unionByName(good)


_RULES = ", ".join(f"('{a}', '{b}')" for a, b in TRANSITIONS)
_WISH = "(['active', 'archived', 'broken', 'enrichment_pending'])[id % 4 + 1]"


@query(f""", allowed(a, b) AS (VALUES {_RULES}) SELECT id, CASE WHEN a IS NULL THEN status ELSE {_WISH} END AS status, a IS NOT NULL AS moved
FROM resources LEFT JOIN allowed ON a = status AND b = {_WISH}""", "resources")  # fmt: skip
def status_transitions(d: Domain) -> DataFrame:
    resources = d.resources()
    wish = F.element_at(F.array(*map(F.lit, ("active", "archived", "broken", "enrichment_pending"))), (F.col("id") % 4 + 1).cast("int"))
    after, refused = res.transition(resources, resources.select("id", wish.alias("to")), EPOCH)
    return after.select("id", "status").join(refused.select("id", F.lit(False).alias("moved")), "id", "left").withColumn("moved", F.coalesce("moved", F.lit(True)))


@query("SELECT status, count(*) AS n FROM resources GROUP BY status", "resources")
def status_counts(d: Domain) -> DataFrame:
    return res.status_counts(d.resources())


@query("SELECT id, title, status, updated_at FROM resources ORDER BY updated_at DESC, id DESC LIMIT 20", "resources")
def resource_recent(d: Domain) -> DataFrame:
    return res.recent(d.resources(), 20).select("id", "title", "status", "updated_at")


@query("SELECT id, title, status, updated_at FROM resources WHERE status IN ('pending_review', 'enrichment_pending') ORDER BY updated_at DESC, id DESC LIMIT 1000", "resources")
def resource_pending(d: Domain) -> DataFrame:
    return res.pending(d.resources()).select("id", "title", "status", "updated_at")


@query("""SELECT id, status, updated_at FROM resources WHERE status = 'active' AND contains(lower(concat_ws(chr(10), title, url, purpose_zh)), 'guide 1') ORDER BY updated_at DESC, id DESC LIMIT 1000""", "resources")
def resource_filter_list(d: Domain) -> DataFrame:
    return res.filter_list(d.resources(), "active", " Guide 1").select("id", "status", "updated_at")


@query("SELECT id FROM resources WHERE status NOT IN ('pending_review', 'archived') OR id % 3 <> 0", "resources")
def resource_delete(d: Domain) -> DataFrame:
    resources = d.resources()
    return res.delete(resources, resources.filter("id % 3 = 0").select("id")).select("id")


_HAY = "coalesce(title, '') || ' ' || url || ' ' || coalesce(purpose_zh, '') || ' ' || coalesce(use_when_zh, '') || ' ' || capability || '  en '"


@query(f""", h AS (SELECT *, {_HAY} AS hay FROM resources WHERE status = 'active'), m AS (SELECT *, trim(regexp_replace(hay, '\\s+', ' ', 'g')) AS flat FROM h WHERE contains(lower(hay), 'guide') AND contains(lower(hay), 'example'))
SELECT id, 1.0 + coalesce(manual_rating, 0) * 0.05 AS score, left(flat, 160) AS snippet FROM m ORDER BY coalesce(manual_rating, 0) DESC, updated_at DESC, id DESC LIMIT 15""", "resources")  # fmt: skip
def resource_search(d: Domain) -> DataFrame:
    return res.search_resources(d.resources(), None, "Guide example", 15).select("id", "score", "snippet")


def _articles_sql(scope: str) -> str:
    return f""", m AS (SELECT *, coalesce(published, fetched_at) AS shown_at, trim(regexp_replace(concat_ws(' ', title, content), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS flat FROM articles
  WHERE NOT archived AND {scope} AND contains(lower(coalesce(title, '') || chr(10) || coalesce(content, '') || chr(10) || coalesce(url, '')), 'apache license'))
SELECT id, CASE WHEN feed_id = 0 THEN 'web_clipping' ELSE 'article' END AS kind, shown_at,
  CASE WHEN instr(lower(flat), 'apache license') > 0 THEN substr(flat, greatest(instr(lower(flat), 'apache license') - 41, 1), instr(lower(flat), 'apache license') - greatest(instr(lower(flat), 'apache license') - 41, 1) + 94) ELSE left(flat, 160) END AS snippet
FROM m ORDER BY shown_at DESC, id DESC LIMIT 25"""


@query(_articles_sql("(starred OR feed_id = 0)"), "articles")
def article_search_curated(d: Domain) -> DataFrame:
    return res.search_articles(d.articles(), d.feeds(), "Apache License", 25).select("id", "kind", F.col("at").alias("shown_at"), "snippet")


@query(_articles_sql("true"), "articles")
def article_search_all(d: Domain) -> DataFrame:
    return res.search_articles(d.articles(), d.feeds(), "Apache License", 25, every=True).select("id", "kind", F.col("at").alias("shown_at"), "snippet")


@query(f""", r AS (SELECT 0 AS part, 'resource' AS result_type, id, coalesce(manual_rating, 0) AS o1, updated_at AS o2 FROM resources WHERE status = 'active' AND contains(lower({_HAY}), 'spam-farm') ORDER BY o1 DESC, o2 DESC, id DESC LIMIT 12),
a AS (SELECT 1 AS part, 'article' AS result_type, id, 0 AS o1, coalesce(published, fetched_at) AS o2 FROM articles WHERE NOT archived AND contains(lower(coalesce(title, '') || chr(10) || coalesce(content, '') || chr(10) || coalesce(url, '')), 'spam-farm') ORDER BY o2 DESC, id DESC LIMIT 12)
SELECT result_type, id FROM (SELECT * FROM r UNION ALL SELECT * FROM a) ORDER BY part, o1 DESC, o2 DESC, id DESC LIMIT 12""", "resources articles")  # fmt: skip
def combined_search(d: Domain) -> DataFrame:
    return res.search(d.resources(), None, d.articles(), d.feeds(), "spam-farm", 12, every=True).select("result_type", "id")


@query(f""", p AS (SELECT id, {_CANON} AS c FROM articles WHERE feed_id = 0 AND url IS NOT NULL)
SELECT p.id AS article_id, p.c IN (SELECT canonical_url FROM resources WHERE id % 2 = 0) OR p.id IN (SELECT linked_article_id FROM resources WHERE source = 'import' AND linked_article_id IS NOT NULL AND id % 2 = 0) AS already_imported FROM p""", "articles resources")  # fmt: skip
def import_preview(d: Domain) -> DataFrame:
    return res.import_preview(d.clippings(), d.resources().filter("id % 2 = 0")).select("article_id", "already_imported")


@query(f""", known AS (SELECT * FROM resources WHERE id % 2 = 0), p AS (SELECT id, url, {_CANON} AS c FROM articles WHERE feed_id = 0 AND url IS NOT NULL)
SELECT canonical_url, linked_article_id, status, source FROM known UNION ALL
SELECT c, min(id), 'active', 'import' FROM p WHERE c NOT IN (SELECT canonical_url FROM known) AND id NOT IN (SELECT linked_article_id FROM known WHERE source = 'import' AND linked_article_id IS NOT NULL) GROUP BY c""", "articles resources")  # fmt: skip
def import_apply(d: Domain) -> DataFrame:
    return res.import_clippings(d.resources().filter("id % 2 = 0"), d.clippings(), EPOCH).select("canonical_url", "linked_article_id", "status", "source")


_FETCHED = f"""f AS (SELECT user_id::BIGINT AS resource_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'timeout' END AS fetch_error, event_type AS title, (event_id // 40 % 3)::VARCHAR AS content, {EPOCH} + event_id AS fetched_at FROM events)"""


@query(f"""WITH {_FETCHED}, h AS (SELECT *, CASE WHEN fetch_error IS NULL THEN sha256(encode(title) || '\\x00'::BLOB || encode(content)) END AS content_hash FROM f),
k AS (SELECT resource_id, content_hash, min(seq) AS seq FROM h WHERE content_hash IS NOT NULL GROUP BY ALL)
SELECT resource_id, content_hash, fetched_at, fetch_error FROM h WHERE content_hash IS NULL OR seq IN (SELECT seq FROM k)""")  # fmt: skip
def snapshot_dedup(d: Domain) -> DataFrame:
    e = d.raw("events")
    fetched = e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("long").alias("resource_id"), F.lit(None).cast("string").alias("fetched_url"), F.lit(200).cast("long").alias("http_status"), F.col("event_type").alias("title"), (F.floor(F.col("event_id") / 40) % 3).cast("string").alias("cleaned_content"), (EPOCH + F.col("event_id")).alias("fetched_at"), F.when(F.col("event_type") == "error", "timeout").alias("fetch_error"))
    snapshots, _ = res.record_snapshots(d.spark.createDataFrame([], TABLES["resource_snapshots"]), d.resources(), fetched)
    return snapshots.select("resource_id", "content_hash", "fetched_at", "fetch_error")


@query("""WITH u AS (SELECT event_id AS seq, user_id::BIGINT AS resource_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE upper(event_type) END AS name, (['zh', 'en', 'other'])[event_id % 3 + 1] AS language,
  CASE WHEN event_id % 7 = 0 THEN 'manual' ELSE 'ai' END AS source FROM events)
SELECT resource_id, arg_min(name, seq) AS name, coalesce(arg_min(language, seq) FILTER (source = 'manual'), arg_max(language, seq)) AS language, CASE WHEN bool_or(source = 'manual') THEN 'manual' ELSE 'ai' END AS source FROM u GROUP BY resource_id, lower(name)""")  # fmt: skip
def tag_provenance_merge(d: Domain) -> DataFrame:
    i = F.col("event_id")
    upserts = d.raw("events").select(i.alias("seq"), F.col("user_id").cast("long").alias("resource_id"), F.when(i % 2 == 0, F.col("event_type")).otherwise(F.upper("event_type")).alias("name"), F.element_at(F.array(F.lit("zh"), F.lit("en"), F.lit("other")), (i % 3 + 1).cast("int")).alias("language"), F.when(i % 7 == 0, "manual").otherwise("ai").alias("source"), F.lit(EPOCH).cast("long").alias("created_at"))
    return res.merge_tags(d.spark.createDataFrame([], TABLES["resource_tags"]), upserts).select("resource_id", "name", "language", "source")


def _answers(d: Domain) -> DataFrame:
    """An invented answer for each page: good ones, fenced ones, and each kind of mistake."""
    p = F.col("page_id")
    body = F.to_json(F.struct(F.when(p % 7 == 1, F.lit(" ")).otherwise(F.concat(F.lit("Use "), p.cast("string"))).alias("purpose_zh"), F.lit("often").alias("use_when_zh"), F.array(F.lit("search")).alias("capabilities"), F.array(F.when(p % 7 == 2, F.lit("nonsense")).otherwise(F.lit("docs"))).alias("categories"), F.array(F.lit("tag")).alias("tags_en"), F.when(p % 7 == 3, F.lit("trial")).otherwise(F.lit("free")).alias("pricing")))
    return d.raw("pages").select(p.alias("resource_id"), F.when(p % 7 == 4, F.lit("no object")).when(p % 7 == 5, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("raw"))


@query("""SELECT page_id AS resource_id, CASE page_id % 7 WHEN 1 THEN 'invalid purpose_zh' WHEN 2 THEN 'invalid categories' WHEN 3 THEN 'invalid pricing' WHEN 4 THEN 'not valid JSON: no object' END AS error FROM pages""")
def enrichment_validate(d: Domain) -> DataFrame:
    return enrich.validate(_answers(d)).select("resource_id", "error")


@query("""SELECT id, CASE WHEN id % 7 IN (0, 5, 6) AND coalesce(purpose_source, '') <> 'manual' THEN 'Use ' || id ELSE purpose_zh END AS purpose_zh,
  CASE WHEN id % 7 IN (0, 5, 6) AND coalesce(purpose_source, '') <> 'manual' THEN 'ai' ELSE purpose_source END AS purpose_source, CASE WHEN id % 7 IN (0, 5, 6) THEN 'free' END AS pricing FROM resources""", "resources")  # fmt: skip
def enrichment_apply(d: Domain) -> DataFrame:
    none = lambda t: d.spark.createDataFrame([], TABLES[t])
    after, _, _ = enrich.apply(d.resources(), none("resource_categories"), none("resource_tags"), enrich.validate(_answers(d)), EPOCH)
    return after.select("id", "purpose_zh", "purpose_source", "pricing")


@query("SELECT r.id AS resource_id, length(coalesce(a.content, '')) AS size FROM resources r LEFT JOIN articles a ON a.id = r.linked_article_id WHERE r.privacy = 'public'", "resources articles")
def private_barrier(d: Domain) -> DataFrame:
    return enrich.inputs(d.resources(), d.spark.createDataFrame([], TABLES["resource_snapshots"]), d.articles()).select("resource_id", F.length("cleaned_content").cast("long").alias("size"))


@query("""SELECT user_id::BIGINT AS resource_id, count(*) FILTER (event_type = 'view') AS returned, count(*) FILTER (event_type = 'purchase') AS confirmed_used, max(event_id) AS last FROM events WHERE event_type IN ('view', 'purchase') GROUP BY user_id""")
def usage_event_counts(d: Domain) -> DataFrame:
    kinds = F.when(F.col("event_type") == "view", "returned").when(F.col("event_type") == "purchase", "confirmed_used")
    events = d.raw("events").select(F.col("user_id").cast("long").alias("resource_id"), kinds.alias("event"), F.col("event_id").alias("occurred_at")).filter("event is not null")
    return res.usage_counts(events)


@query("""SELECT page_id AS id, strftime(to_timestamp(1704067200 + page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS rfc3339, strftime(to_timestamp(1704067200 + page_id) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS minute FROM pages""")
def time_formats(d: Domain) -> DataFrame:
    at = (EPOCH + F.col("page_id")).cast("long")
    return d.raw("pages").select(F.col("page_id").alias("id"), scalars.rfc3339(at).alias("rfc3339"), scalars.minute(at).alias("minute"))




@query(f"""SELECT id, CASE WHEN id % 5 = 0 THEN 'Edited ' || id ELSE title END AS title, CASE WHEN id % 5 = 0 THEN CASE WHEN id % 2 = 0 THEN 'by hand' END ELSE purpose_zh END AS purpose_zh,
  CASE WHEN id % 10 = 0 THEN 'manual' ELSE purpose_source END AS purpose_source, CASE WHEN id % 5 = 0 THEN 4 ELSE manual_rating END AS manual_rating, CASE WHEN id % 5 = 0 THEN {EPOCH} ELSE updated_at END AS updated_at FROM resources""", "resources")  # fmt: skip
def resource_manual_edits(d: Domain) -> DataFrame:
    """Every fifth resource is edited by hand; edits of id 1 have a rating that is refused."""
    i = F.col("id")
    edits = d.resources().filter((i % 5 == 0) | (i == 1)).select("id", F.concat(F.lit("Edited "), i.cast("string")).alias("title"), F.when(i % 2 == 0, "by hand").alias("purpose_zh"), F.lit(None).cast("string").alias("private_note"), "privacy", F.when(i == 1, 9).otherwise(4).cast("long").alias("manual_rating"))
    return res.update_manual(d.resources(), edits, EPOCH).select("id", "title", "purpose_zh", "purpose_source", "manual_rating", "updated_at")


@query(f"""SELECT id, coalesce(title, CASE WHEN id % 3 = 0 THEN 'Fetched ' || id END) AS title, CASE WHEN id % 3 = 0 THEN {EPOCH} END AS last_checked_at,
  CASE WHEN id % 7 = 0 THEN 'paid' END AS pricing FROM (SELECT id, CASE WHEN id % 4 <> 0 THEN title END AS title FROM resources)""", "resources")  # fmt: skip
def resource_titles_and_content(d: Domain) -> DataFrame:
    """Titles fetched for every third resource fill those that have none; every seventh gets a price, one an empty phrase."""
    i = F.col("id")
    rows = d.resources().withColumn("title", F.when(i % 4 != 0, F.col("title")))
    rows = res.fill_title(rows, rows.filter(i % 3 == 0).select("id", F.concat(F.lit("Fetched "), i.cast("string")).alias("title")), EPOCH)
    edits = rows.filter((i % 7 == 0) | (i == 1)).select("id", F.lit("paid").alias("pricing"), F.when(i == 1, F.array(F.lit(" "))).otherwise(F.array(F.lit("x"))).alias("limitations"))
    return res.update_content(rows, edits, EPOCH).select("id", "title", "last_checked_at", "pricing")


_KINDS = "(['tool', 'docs', 'nonsense'])[id % 3 + 1]"


@query(f"""SELECT id AS source_id, md5(trim(coalesce(title, '') || chr(10) || url || chr(10) || coalesce(purpose_zh, '') || chr(10) || coalesce(use_when_zh, '') || chr(10) || '["' || capability || '"]' || chr(10) || '[]' || chr(10) || '["en"]' || chr(10) || '' || chr(10)
  || CASE WHEN {_KINDS} <> 'nonsense' THEN {_KINDS} ELSE '' END || chr(10) || CASE WHEN id % 2 = 0 THEN 'a' || id || ' b' ELSE '' END || chr(10), ' ')) AS body_md5 FROM resources""", "resources")  # fmt: skip
def resource_index_bodies(d: Domain) -> DataFrame:
    """Index texts of resources with categories (those of the vocabulary alone) and tags."""
    none = lambda t: d.spark.createDataFrame([], TABLES[t])
    kind = F.element_at(F.array(F.lit("tool"), F.lit("docs"), F.lit("nonsense")), (F.col("id") % 3 + 1).cast("int"))
    categories = res.set_categories(none("resource_categories"), d.resources().select(F.col("id").alias("resource_id"), kind.alias("category")))
    names = F.explode(F.array(F.concat(F.lit("a"), F.col("id").cast("string")), F.lit("b"), F.lit("B"))).alias("name")
    upserts = d.resources().filter("id % 2 = 0").select(F.col("id").alias("resource_id"), names).select("resource_id", "name", F.when(F.col("name") == "B", 2).otherwise(1).cast("long").alias("seq"), F.lit("en").alias("language"), F.lit("ai").alias("source"), F.lit(0).cast("long").alias("created_at"))
    bodies = res.index_bodies(d.resources(), categories, res.merge_tags(none("resource_tags"), upserts), none("resource_snapshots"))
    return bodies.select("source_id", F.md5("body").alias("body_md5"))


@query("""SELECT id::VARCHAR AS id, 'resource' AS result_type, (['site', 'page', 'article'])[id % 3 + 1] AS kind, 'recent' AS field, linked_article_id::VARCHAR AS article_id, strftime(to_timestamp(updated_at) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS updated_at,
  'text_match,' || CASE WHEN manual_rating IS NULL THEN 'no_rating_boost' ELSE 'manual_rating_boost' END AS factors, [capability] AS capabilities FROM resources""", "resources")  # fmt: skip
def resource_result_fields(d: Domain) -> DataFrame:
    """What the command line prints of resources, read back from the JSON."""
    none = lambda t: d.spark.createDataFrame([], TABLES[t])
    schema = "id string, result_type string, kind string, matched_fields array<string>, evidence_snippets array<struct<article_id:string>>, updated_at string, score_factors array<string>, capabilities array<string>"
    j = res.to_json_rows(d.resources(), none("resource_categories"), none("resource_tags"), "recent").select(F.from_json("json", schema).alias("j"))
    return j.select("j.id", "j.result_type", "j.kind", F.col("j.matched_fields")[0].alias("field"), F.col("j.evidence_snippets")[0]["article_id"].alias("article_id"), "j.updated_at", F.array_join("j.score_factors", ",").alias("factors"), "j.capabilities")


@query(""", h AS (
  SELECT id, url, manual_rating, updated_at, lower(coalesce(title, '') || ' ' || url || ' ' || coalesce(purpose_zh, '') || ' ' || coalesce(use_when_zh, '') || ' ' || capability || '  en ') AS hay FROM resources WHERE status = 'active'),
q AS (SELECT url, 'guide ' || id % 17 || ' reading ' || id % 11 AS query FROM resources WHERE id % 10 = 0 AND id % 3 <> 0),
hit AS (SELECT query, url, row_number() OVER (PARTITION BY query ORDER BY coalesce(manual_rating, 0) DESC, updated_at DESC, id DESC) AS rank
  FROM (SELECT DISTINCT query FROM q) JOIN h ON len(list_filter(string_split(query, ' '), lambda t: NOT contains(hay, t))) = 0)
SELECT q.query, q.url, rank::INT AS rank, rank IS NOT NULL AS ok FROM q LEFT JOIN hit ON hit.query = q.query AND hit.url = q.url AND rank <= 5""", "resources")  # fmt: skip
def acceptance_top5(d: Domain) -> DataFrame:
    """Searches by words that rivals share too: whether the resource that each was made for is among the first five."""
    stored = d.resources()
    words = F.concat(F.lit("guide "), (F.col("id") % 17).cast("string"), F.lit(" reading "), (F.col("id") % 11).cast("string"))
    accepted = stored.filter("id % 10 = 0 and id % 3 <> 0").select(words.alias("query"), "url")
    return res.acceptance(res.search_many(stored, None, accepted, 5), accepted).select("query", "url", "rank", "ok")


@query("""SELECT user_id::BIGINT AS resource_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status, count(*) AS n, count(DISTINCT event_id) AS ids, min(event_id)::BIGINT AS first FROM events GROUP BY ALL""")
def enrichment_run_log(d: Domain) -> DataFrame:
    """A run for each event, started together and finished with its outcome; ids are told apart by their snapshot."""
    e = d.raw("events")
    new = e.select(F.col("user_id").cast("long").alias("resource_id"), F.col("event_id").cast("long").alias("snapshot_id"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit("1").alias("prompt_version"), F.lit("1").alias("schema_version"))
    runs = res.start_run(d.spark.createDataFrame([], TABLES["resource_enrichment_runs"]), new, EPOCH)
    ends = runs.join(e.select(F.col("event_id").cast("long").alias("snapshot_id"), "event_type"), "snapshot_id").select("id", F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"))
    done = res.finish_run(runs, ends, EPOCH + 9).filter(F.col("finished_at") == EPOCH + 9)
    return done.groupBy("resource_id", "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.min("snapshot_id").alias("first"))
