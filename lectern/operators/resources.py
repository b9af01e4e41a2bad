"""Resource catalogue: deduplicated creation, states, provenance-aware updates, snapshots, import, evidence search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import patterns
from lectern.functions.scalars import rfc3339, snapshot_hash
from lectern.functions.urls import canonical
from lectern.operators.library import number
from lectern.schema import CLIPPINGS_URL, TRANSITIONS, VOCABULARY, conform
from lectern.shared import materialize


def create(resources: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(resources, rejects) after adding rows (seq, url, kind, title, private_note, privacy, source, manual_rating).

    An address may be there once by its canonical form; of a batch the smallest seq stays. Rejects carry an error.
    """
    rows = new.withColumn("canonical_url", canonical(F.col("url")))
    wrong = F.when(F.col("canonical_url").isNull(), "bad address").when(~F.col("manual_rating").between(1, 5), "bad rating")
    rows = rows.withColumn("error", wrong)
    first = rows.filter("error is null").groupBy("canonical_url").agg(F.min("seq").alias("first"))
    # stored addresses may repeat: a known address still rejects a row once
    taken = resources.select("canonical_url", F.lit(True).alias("taken")).distinct()
    rows = rows.join(first, "canonical_url", "left").join(taken, "canonical_url", "left")
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("taken") | (F.col("seq") != F.col("first")), F.lit("duplicate"))))
    good = number(rows.filter("error is null"), ["seq"]).crossJoin(F.broadcast(resources.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))))
    status = F.when(F.col("source") == "cli_agent", "pending_review").otherwise("enrichment_pending")
    good = good.withColumns({"id": F.col("top") + F.col("n"), "url": F.trim("url"), "status": status, "created_at": F.lit(now), "updated_at": F.lit(now)})
    return resources.unionByName(conform(good, "resources")), rows.filter("error is not null").select(*new.columns, "error")


def first_by_address(rows: DataFrame) -> DataFrame:
    """One row for each canonical address, the one of the smallest id; other rows and bad addresses are left out."""
    own = rows.withColumn("canonical", canonical(F.col("url"))).filter("canonical is not null")
    return own.groupBy("canonical").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def transition(resources: DataFrame, wishes: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(resources, refused) after status changes (id, to), one for each id; refused have an error."""
    spark = resources.sparkSession
    allowed = spark.createDataFrame(TRANSITIONS, "status string, to string").withColumn("ok", F.lit(True))  # nine rows
    asked = wishes.join(resources.select("id", "status"), "id", "left").join(F.broadcast(allowed), ["status", "to"], "left")
    refused = asked.filter("ok is null").select("id", "to", F.when(F.col("status").isNull(), "not found").otherwise("not allowed").alias("error"))
    done = asked.filter("ok").select(F.col("id").alias("t_id"), F.col("to").alias("t_to"))
    rows = resources.join(done, F.col("id") == F.col("t_id"), "left")
    rows = rows.withColumn("status", F.coalesce("t_to", "status")).withColumn("updated_at", F.when(F.col("t_id").isNotNull(), F.lit(now).cast("long")).otherwise(F.col("updated_at")))
    return rows.drop("t_id", "t_to"), refused


def delete(resources: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the resources in ids that wait for review or are archived; others stay."""
    gone = resources.join(ids.select("id").distinct(), "id", "left_semi").filter(F.col("status").isin("pending_review", "archived")).select(F.col("id").alias("gone"))
    return resources.join(gone, F.col("id") == F.col("gone"), "left_anti")


def update_manual(resources: DataFrame, edits: DataFrame, now: int) -> DataFrame:
    """Edits by hand (id, title, purpose_zh, private_note, privacy, manual_rating): a purpose given marks it manual."""
    e = edits.filter(F.col("manual_rating").isNull() | F.col("manual_rating").between(1, 5)).select(F.col("id").alias("e_id"), *(F.col(c).alias(f"e_{c}") for c in ("title", "purpose_zh", "private_note", "privacy", "manual_rating")))
    rows = resources.join(e, F.col("id") == F.col("e_id"), "left")
    hit = F.col("e_id").isNotNull()
    sets = {c: F.when(hit, F.col(f"e_{c}")).otherwise(F.col(c)) for c in ("title", "purpose_zh", "private_note", "privacy", "manual_rating")}
    sets |= {"purpose_source": F.when(hit & F.col("e_purpose_zh").isNotNull(), "manual").otherwise(F.col("purpose_source")), "updated_at": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at"))}
    return rows.withColumns(sets).select(*resources.columns)


def update_content(resources: DataFrame, edits: DataFrame, now: int) -> DataFrame:
    """Replaces descriptive fields (id and any of the table's columns) of the resources in edits; checked phrases only."""
    fields = [c for c in edits.columns if c != "id" and c in resources.columns]
    lists = [c for c in fields if c in ("capabilities", "limitations", "languages")]
    good = edits
    for c in lists:
        good = good.filter(F.forall(c, lambda x: (F.length(F.trim(x)) > 0) & (F.length(x) <= 500)))
    e = good.select(F.col("id").alias("e_id"), *(F.col(c).alias(f"e_{c}") for c in fields))
    rows = resources.join(e, F.col("id") == F.col("e_id"), "left")
    hit = F.col("e_id").isNotNull()
    return rows.withColumns({c: F.when(hit, F.col(f"e_{c}")).otherwise(F.col(c)) for c in fields} | {"updated_at": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at"))}).select(*resources.columns)


def fill_title(resources: DataFrame, fetched: DataFrame, now: int) -> DataFrame:
    """Fetched titles (id, title) where none is there yet; the check time moves either way."""
    f = fetched.select(F.col("id").alias("f_id"), F.col("title").alias("f_title"))
    rows = resources.join(f, F.col("id") == F.col("f_id"), "left")
    hit = F.col("f_id").isNotNull()
    stamp = lambda c: F.when(hit, F.lit(now).cast("long")).otherwise(F.col(c))
    return rows.withColumns({"title": F.when(hit, F.coalesce("title", "f_title")).otherwise(F.col("title")), "last_checked_at": stamp("last_checked_at"), "updated_at": stamp("updated_at")}).select(*resources.columns)


def set_categories(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Replaces the categories of the resources in wanted (resource_id, category); unknown and repeated ones are dropped."""
    known = wanted.filter(F.col("category").isin(VOCABULARY["resource_categories", "category"])).distinct()
    return stored.join(wanted.select("resource_id").distinct(), "resource_id", "left_anti").unionByName(known.select(*stored.columns))


def merge_tags(stored: DataFrame, upserts: DataFrame) -> DataFrame:
    """Tags after upserts (seq, resource_id, name, language, source, created_at): one per name without regard to case.

    The first spelling stays. Once a tag is manual, its language and source stay; before, the latest upsert decides.
    """
    old = stored.withColumn("seq", F.lit(-1).cast("long"))
    new = upserts.withColumn("name", F.trim("name")).filter("length(name) between 1 and 100").select(*old.columns)
    manual = F.min(F.when(F.col("source") == "manual", F.struct("seq", "language")))
    last = F.max(F.struct("seq", "language", "source"))
    rows = old.unionByName(new).groupBy("resource_id", F.lower("name").alias("key")).agg(F.min(F.struct("seq", "name", "created_at")).alias("first"), manual.alias("manual"), last.alias("last"))
    return rows.select("resource_id", F.col("first.name").alias("name"), F.coalesce("manual.language", "last.language").alias("language"), F.when(F.col("manual").isNotNull(), "manual").otherwise(F.col("last.source")).alias("source"), F.col("first.created_at").alias("created_at"))


def record_snapshots(snapshots: DataFrame, resources: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots, resources) after fetches (seq, resource_id, fetched_url, http_status, title, cleaned_content, fetched_at, fetch_error).

    An error is a row without hash; a content known for its resource makes no row and does not move the latest snapshot.
    """
    rows = fetched.withColumn("content_hash", F.when(F.col("fetch_error").isNull(), snapshot_hash(F.col("title"), F.col("cleaned_content"))))
    seen = snapshots.filter("content_hash is not null").select("resource_id", "content_hash").distinct()
    fresh = rows.filter("content_hash is not null").join(seen, ["resource_id", "content_hash"], "left_anti")
    first = fresh.groupBy("resource_id", "content_hash").agg(F.min("seq").alias("seq")).select("seq")
    keep = rows.join(first, "seq", "left_semi").unionByName(rows.filter("content_hash is null").withColumn("cleaned_content", F.lit(None).cast("string")))
    top = snapshots.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    keep = number(keep, ["seq"]).crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("n"))
    latest = keep.filter("content_hash is not null").groupBy("resource_id").agg(F.max("id").alias("new_latest"))
    checked = fetched.groupBy("resource_id").agg(F.max("fetched_at").alias("checked"))
    after = checked.join(latest, "resource_id", "left").withColumnRenamed("resource_id", "c_id")
    moved = resources.join(after, F.col("id") == F.col("c_id"), "left").withColumns({"latest_snapshot_id": F.coalesce("new_latest", "latest_snapshot_id"), "last_checked_at": F.coalesce("checked", "last_checked_at"), "updated_at": F.coalesce("checked", "updated_at")})
    return snapshots.unionByName(conform(keep, "resource_snapshots")), moved.select(*resources.columns)


def import_preview(clippings: DataFrame, resources: DataFrame) -> DataFrame:
    """(article_id, url, title, already_imported) of clippings with an address: known by address or as an import."""
    rows = clippings.filter("url is not null").select(F.col("id").alias("article_id"), "url", "title", canonical(F.col("url")).alias("c"))
    by_url = resources.select(F.col("canonical_url").alias("c")).distinct().withColumn("u", F.lit(True))
    by_id = resources.filter("source = 'import' and linked_article_id is not null").select(F.col("linked_article_id").alias("article_id")).distinct().withColumn("l", F.lit(True))
    out = rows.join(by_url, "c", "left").join(by_id, "article_id", "left")
    return out.select("article_id", "url", "title", (F.col("u").isNotNull() | F.col("l").isNotNull()).alias("already_imported"))


def import_clippings(resources: DataFrame, clippings: DataFrame, now: int) -> DataFrame:
    """Adds clippings that are not there yet as active public articles; of equal addresses the smallest id stays."""
    fresh = import_preview(clippings, resources).filter("not already_imported").withColumn("canonical_url", canonical(F.col("url"))).filter("canonical_url is not null")
    one = fresh.groupBy("canonical_url").agg(F.min(F.struct("article_id", "url", "title")).alias("r")).select("canonical_url", "r.*")
    top = resources.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = number(one, ["article_id"]).crossJoin(F.broadcast(top)).withColumns({"id": F.col("top") + F.col("n"), "linked_article_id": F.col("article_id"), "kind": F.lit("article"), "privacy": F.lit("public"), "status": F.lit("active"), "source": F.lit("import"), "created_at": F.lit(now), "updated_at": F.lit(now)})
    return resources.unionByName(conform(new, "resources"))


def recent(resources: DataFrame, limit: int) -> DataFrame:
    return resources.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)


def pending(resources: DataFrame, limit: int = 1000) -> DataFrame:
    return recent(resources.filter(F.col("status").isin("pending_review", "enrichment_pending")), limit)


def status_counts(resources: DataFrame) -> DataFrame:
    return resources.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def filter_list(resources: DataFrame, status: str | None, text: str) -> DataFrame:
    """The list of the catalogue window: a status (or all) and a case-folded substring of title, address, purpose, note."""
    out = resources if status is None else resources.filter(F.col("status") == status)
    hay = F.lower(F.concat_ws("\n", "title", "url", "purpose_zh", "private_note"))
    return recent(out.filter(F.contains(hay, F.lit(text.strip().lower()))), 1000)


def index_bodies(resources: DataFrame, categories: DataFrame, tags: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(source_id, body): the text by which a resource can be found."""
    c = categories.groupBy("resource_id").agg(F.array_join(F.array_sort(F.collect_list("category")), " ").alias("c"))
    t = tags.groupBy("resource_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("t"))
    s = snapshots.select(F.col("id").alias("latest_snapshot_id"), "cleaned_content")
    rows = resources.join(c, F.col("id") == c["resource_id"], "left").drop("resource_id").join(t, F.col("id") == t["resource_id"], "left").join(s, "latest_snapshot_id", "left")
    text = lambda x: F.coalesce(x, F.lit(""))
    parts = [text(F.col(x)) for x in ("title", "url", "purpose_zh", "use_when_zh")] + [F.coalesce(F.to_json(x), F.lit("[]")) for x in ("capabilities", "limitations", "languages")] + [text(F.col(x)) for x in ("private_note", "c", "t", "cleaned_content")]
    body = parts[0]
    for p in parts[1:]:
        body = F.concat(body, F.lit("\n"), p)
    return rows.select(F.col("id").alias("source_id"), F.trim(body).alias("body"))


def evidence_snippet(text: Column, query: str) -> Column:
    """White space collapsed; from 41 characters before the query to 80 after its length, or the first 160."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    at = F.instr(F.lower(flat), query.lower())
    start = F.greatest(at - 41, F.lit(1))
    return F.when(at > 0, F.substring(flat, start, at - start + len(query) + 80)).otherwise(F.substring(flat, 1, 160))


def _haystack(snapshot: Column) -> Column:
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    parts = [e("title"), e("url"), e("purpose_zh"), e("use_when_zh"), *(F.coalesce(F.array_join(c, " "), F.lit("")) for c in ("capabilities", "limitations", "languages")), F.coalesce(snapshot, F.lit(""))]
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit(" "), p)
    return out


def search_resources(resources: DataFrame, snapshots: DataFrame | None, query: str, limit: int, strict: bool = False) -> DataFrame:
    """Active resources that hold all terms, best rated and latest first: id, url, title, score, snippet, updated_at.

    Without strict, the limit applies to hits. With strict, at most `limit` (for terms under three characters: 1000)
    candidates are cut first and filtered afterwards.
    """
    query = query.strip()
    terms = [t.lower() for t in query.split()]
    rows = resources.filter("status = 'active'")
    if snapshots is not None:
        rows = rows.join(snapshots.select(F.col("id").alias("latest_snapshot_id"), F.col("cleaned_content").alias("snapshot")), "latest_snapshot_id", "left")
    else:
        rows = rows.withColumn("snapshot", F.lit(None).cast("string"))
    rows = rows.withColumn("hay", _haystack(F.col("snapshot")))
    order = [F.coalesce("manual_rating", F.lit(0)).desc(), F.desc("updated_at"), F.desc("id")]
    if not terms or limit <= 0:
        rows = rows.limit(0)
    if strict:
        rows = rows.orderBy(*order).limit(limit if all(len(t) >= 3 for t in terms) else 1000)
    for t in terms:
        rows = rows.filter(F.contains(F.lower("hay"), F.lit(t)))
    score = 1.0 + F.coalesce("manual_rating", F.lit(0)) * 0.05
    return rows.orderBy(*order).limit(limit).select("id", "url", "title", score.alias("score"), F.lit("multi_field").alias("matched_field"), evidence_snippet(F.col("hay"), query).alias("snippet"), "manual_rating", "updated_at")


#: Queries that are sent to all tasks at most.
FEW_QUERIES = 100_000


def search_many(resources: DataFrame, snapshots: DataFrame | None, queries: DataFrame, limit: int) -> DataFrame:
    """(query, rank, id, url): what search_resources finds for each of many queries (column `query`), in one pass over the
    resources: all terms are sought at once, and a query's hits are the resources that hold all of its terms."""
    rows = resources.filter("status = 'active'")
    if snapshots is not None:
        rows = rows.join(snapshots.select(F.col("id").alias("latest_snapshot_id"), F.col("cleaned_content").alias("snapshot")), "latest_snapshot_id", "left")
    else:
        rows = rows.withColumn("snapshot", F.lit(None).cast("string"))
    texts = rows.select(F.col("id").alias("doc_id"), F.lower(_haystack(F.col("snapshot"))).alias("text"))
    words = F.array_distinct(F.filter(F.split(F.lower("query"), r"\s+"), lambda w: F.length(w) > 0))
    asked = queries.select("query").distinct().withColumn("terms", words)
    terms = asked.select("query", F.explode("terms").alias("item_id"))
    found = materialize(patterns.counts(texts, terms.select("item_id", F.col("item_id").alias("quote")).distinct()).select("doc_id", "item_id"), "found-terms")
    # a query is compared with the resources that hold its rarest term, not with all that hold any
    held = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("held"))
    rarest = terms.join(held, "item_id", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "item_id"))["item_id"].alias("rarest"))
    sought = materialize(asked.select("query", "terms").join(rarest, "query"), "sought")
    sought = F.broadcast(sought) if sought.count() <= FEW_QUERIES else sought
    has = found.groupBy("doc_id").agg(F.collect_set("item_id").alias("has"))
    hits = has.withColumn("rarest", F.explode("has")).join(sought, "rarest").filter(F.size(F.array_except("terms", "has")) == 0).select("query", "doc_id")
    order = Window.partitionBy("query").orderBy(F.coalesce("manual_rating", F.lit(0)).desc(), F.desc("updated_at"), F.desc("id"))
    ranked = hits.join(rows.select(F.col("id").alias("doc_id"), "id", "url", "manual_rating", "updated_at"), "doc_id").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= limit).select("query", "rank", "id", "url")


def search_articles(articles: DataFrame, feeds: DataFrame, query: str, limit: int, every: bool = False) -> DataFrame:
    """Articles that hold the whole query: curated ones (starred or clipped), or all that are not archived; newest first."""
    query = query.strip()
    kinds = feeds.select(F.col("id").alias("f_id"), (F.col("url") == CLIPPINGS_URL).alias("clip"))
    rows = articles.filter(~F.col("archived")).join(kinds, F.col("feed_id") == F.col("f_id"))
    rows = rows if every else rows.filter(F.col("starred") | F.col("clip"))
    hay = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n"), F.coalesce("url", F.lit("")))
    hits = rows.filter(F.contains(F.lower(hay), F.lit(query.lower()))) if query and limit > 0 else rows.limit(0)
    hits = hits.withColumn("at", F.coalesce("published", "fetched_at")).orderBy(F.desc("at"), F.desc("id")).limit(limit)
    return hits.select("id", "url", "title", F.when(F.col("clip"), "web_clipping").otherwise("article").alias("kind"), F.lit(1.0).alias("score"), evidence_snippet(F.concat_ws(" ", "title", "content"), query).alias("snippet"), "at")


def _ranked(resources: DataFrame, snapshots: DataFrame | None, articles: DataFrame, feeds: DataFrame, query: str, limit: int, every: bool, strict: bool) -> DataFrame:
    """Resources, then articles, cut to limit together, with the columns o1 and o2 of their order."""
    r = search_resources(resources, snapshots, query, limit, strict).select(F.lit(0).alias("part"), F.lit("resource").alias("result_type"), "id", "url", "title", "score", "snippet", F.coalesce("manual_rating", F.lit(0)).alias("o1"), F.col("updated_at").alias("o2"))
    a = search_articles(articles, feeds, query, limit, every).select(F.lit(1).alias("part"), F.lit("article").alias("result_type"), "id", "url", "title", "score", "snippet", F.lit(0).cast("long").alias("o1"), F.col("at").alias("o2"))
    return r.unionByName(a).orderBy("part", F.desc("o1"), F.desc("o2"), F.desc("id")).limit(limit)


def search(resources: DataFrame, snapshots: DataFrame | None, articles: DataFrame, feeds: DataFrame, query: str, limit: int, every: bool = False, strict: bool = False) -> DataFrame:
    """Resources, then articles, cut to limit together: result_type, id, url, title, score, snippet."""
    return _ranked(resources, snapshots, articles, feeds, query, limit, every, strict).drop("part", "o1", "o2")


_STRINGS = "array<string>"
_TAGS = "array<struct<name:string,language:string,source:string>>"
#: Fields of a result, in the order in which they are printed.
RESULT = (
    "id", "result_type", "url", "title", "kind", "categories", "tags", "purpose_zh", "use_when_zh", "capabilities", "limitations", "pricing", "requires_login", "private_note", "matched_fields", "evidence_snippets",
    "updated_at", "last_checked_at", "status", "score", "score_factors",
)


def _text_id(c: str) -> Column:
    return F.col(c).cast("string")


def score_factors(rating: Column) -> Column:
    """What a resource's score is made of."""
    return F.array(F.lit("text_match"), F.when(rating.isNotNull(), "manual_rating_boost").otherwise("no_rating_boost"))


def resource_results(resources: DataFrame, categories: DataFrame, tags: DataFrame, field: Column, snippet: Column, score: Column) -> DataFrame:
    """Resources as results: the columns RESULT, with categories and tags nested, ids as texts and times in RFC 3339."""
    c = categories.groupBy("resource_id").agg(F.array_sort(F.collect_list("category")).alias("categories"))
    t = tags.groupBy("resource_id").agg(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "name", "language", "source"))).alias("tags"))
    rows = resources.join(c.withColumnRenamed("resource_id", "c_id"), F.col("id") == F.col("c_id"), "left").join(t.withColumnRenamed("resource_id", "t_id"), F.col("id") == F.col("t_id"), "left")
    nested = F.transform("tags", lambda x: F.struct(x["name"].alias("name"), x["language"].alias("language"), x["source"].alias("source")))
    note = F.when(F.col("private_note").isNotNull(), F.struct(F.col("private_note").alias("value"), F.lit("local_private_note").alias("source")))
    evidence = F.array(F.struct(field.alias("source_type"), _text_id("latest_snapshot_id").alias("snapshot_id"), _text_id("linked_article_id").alias("article_id"), snippet.alias("text")))
    sets = {
        "result_type": F.lit("resource"), "categories": F.coalesce("categories", F.array().cast(_STRINGS)), "tags": F.coalesce(nested, F.array().cast(_TAGS)), "private_note": note, "matched_fields": F.array(field), "evidence_snippets": evidence,
        "score": score.cast("double"), "score_factors": score_factors(F.col("manual_rating")), "id": _text_id("id"), **{c: F.coalesce(c, F.array().cast(_STRINGS)) for c in ("capabilities", "limitations")}, "updated_at": rfc3339(F.col("updated_at")), "last_checked_at": rfc3339(F.col("last_checked_at")),
    }
    return rows.select(*(sets[f].alias(f) if f in sets else F.col(f) for f in RESULT))


def article_results(articles: DataFrame, feeds: DataFrame, query: str) -> DataFrame:
    """Articles as results: the columns RESULT, those that only resources have being null or empty."""
    kinds = feeds.select(F.col("id").alias("f_id"), (F.col("url") == CLIPPINGS_URL).alias("clip"))
    rows = articles.join(kinds, F.col("feed_id") == F.col("f_id"))
    text = evidence_snippet(F.coalesce("content", F.lit("")), query)
    none = F.lit(None).cast("string")
    evidence = F.array(F.struct(F.lit("article").alias("source_type"), none.alias("snapshot_id"), _text_id("id").alias("article_id"), text.alias("text")))
    empty = F.array().cast(_STRINGS)
    sets = {
        "id": _text_id("id"), "result_type": F.lit("article"), "kind": F.when(F.col("clip"), "web_clipping").otherwise("article"), "categories": empty, "tags": F.array().cast(_TAGS), "purpose_zh": none, "use_when_zh": none,
        "capabilities": empty, "limitations": empty, "pricing": none, "requires_login": F.lit(None).cast("boolean"), "private_note": F.lit(None).cast("struct<value:string,source:string>"), "matched_fields": F.array(F.lit("article_text")),
        "evidence_snippets": evidence, "updated_at": rfc3339(F.col("fetched_at")), "last_checked_at": none, "status": F.lit("active"), "score": F.lit(1.0), "score_factors": F.array(F.when(F.col("starred"), "starred").otherwise("web_clipping")),
    }
    return rows.select(*(sets[f].alias(f) if f in sets else F.col(f) for f in RESULT))


def _json() -> Column:
    return F.to_json(F.struct(*RESULT), {"ignoreNullFields": "false"})


def search_json(resources: DataFrame, snapshots: DataFrame | None, categories: DataFrame, tags: DataFrame, articles: DataFrame, feeds: DataFrame, query: str, limit: int, every: bool = False, strict: bool = False) -> DataFrame:
    """(rank, json): the results of a search as they are printed, best first."""
    ranked = _ranked(resources, snapshots, articles, feeds, query, limit, every, strict)
    # at most `limit` rows
    order = Window.orderBy("part", F.desc("o1"), F.desc("o2"), F.desc("id"))
    ranked = ranked.select(F.row_number().over(order).alias("rank"), "result_type", F.col("id").alias("r_id"), F.col("score").alias("r_score"), F.col("snippet").alias("r_snippet"))
    own = resources.join(F.broadcast(ranked.filter("result_type = 'resource'").drop("result_type")), F.col("id") == F.col("r_id"))
    places = own.select(F.col("rank"), F.col("r_id").cast("string").alias("p_id"))
    shown = resource_results(own, categories, tags, F.lit("multi_field"), F.col("r_snippet"), F.col("r_score"))
    first = shown.join(places, F.col("id") == F.col("p_id")).select("rank", _json().alias("json"))
    read = articles.join(F.broadcast(ranked.filter("result_type = 'article'").select("rank", "r_id")), F.col("id") == F.col("r_id"))
    places = read.select("rank", F.col("r_id").cast("string").alias("p_id"))
    then = article_results(read, feeds, query).join(places, F.col("id") == F.col("p_id")).select("rank", _json().alias("json"))
    return first.unionByName(then).orderBy("rank")


def to_json_rows(resources: DataFrame, categories: DataFrame, tags: DataFrame, field: str = "id") -> DataFrame:
    """(id, json): resources as the command line prints them; field says why they are shown."""
    snippet = F.col("url") if field == "url" else F.lit("")
    rows = resource_results(resources, categories, tags, F.lit(field), snippet, F.lit(1.0))
    return rows.select(F.col("id").cast("long").alias("id"), _json().alias("json"))


def acceptance(found: DataFrame, accepted: DataFrame, most: int = 5) -> DataFrame:
    """(query, url, rank, ok): whether the accepted address of each query is among its first results.

    found: query, rank, url of the results of many queries; accepted: query, url."""
    own = found.filter(F.col("rank") <= most).groupBy("query", "url").agg(F.min("rank").alias("rank"))
    return accepted.join(own, ["query", "url"], "left").withColumn("ok", F.col("rank").isNotNull())


def start_run(runs: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """The run log with a pending run for each row (resource_id, snapshot_id, provider, model, prompt_version, schema_version)."""
    top = runs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = number(new, ["resource_id", "snapshot_id"]).crossJoin(F.broadcast(top))
    return runs.unionByName(conform(rows.withColumns({"id": F.col("top") + F.col("n"), "started_at": F.lit(now), "status": F.lit("pending")}), "resource_enrichment_runs"))


def finish_run(runs: DataFrame, done: DataFrame, now: int) -> DataFrame:
    """The run log after runs ended (id, status, error_code, error_message)."""
    d = done.select(F.col("id").alias("d_id"), *(F.col(c).alias(f"d_{c}") for c in ("status", "error_code", "error_message")))
    rows, hit = runs.join(d, F.col("id") == F.col("d_id"), "left"), F.col("d_id").isNotNull()
    sets = {c: F.when(hit, F.col(f"d_{c}")).otherwise(F.col(c)) for c in ("status", "error_code", "error_message")}
    return rows.withColumns(sets | {"finished_at": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("finished_at"))}).select(*runs.columns)


def record_usage(events: DataFrame, new: DataFrame) -> DataFrame:
    """The usage log with further events (resource_id, event, occurred_at)."""
    top = events.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = number(new, ["occurred_at", "resource_id", "event"]).crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("n"))
    return events.unionByName(conform(rows, "resource_usage_events"))


def usage_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("resource_id").agg(F.count_if(F.col("event") == "returned").alias("returned"), F.count_if(F.col("event") == "confirmed_used").alias("confirmed_used"), F.max("occurred_at").alias("last"))


def latest_by(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row of each key, the first in order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")
