"""Library views and state changes over feeds, articles, selections and tags.

Views are filters and joins that Catalyst prunes and pushes down; feeds are a small dimension, so joins with them are left
to the size-based broadcast threshold. State changes are projections that return the new table: a caller writes it as the
next version (see tables.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.schema import CLIPPINGS_TITLE, CLIPPINGS_URL, conform
from lectern.shared import numbered


def _listed() -> Column:
    return F.col("url") != CLIPPINGS_URL


def newest() -> list[Column]:
    """Order of article lists: newest first."""
    return [F.coalesce("published", "fetched_at").desc(), F.col("id").desc()]


def due_feeds(feeds: DataFrame, now: int) -> DataFrame:
    return feeds.filter(~F.col("disabled") & _listed() & (F.col("next_fetch") <= now)).orderBy("id")


def enabled_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.filter(~F.col("disabled") & _listed()).orderBy("id")


def earliest_next_fetch(feeds: DataFrame) -> DataFrame:
    return enabled_feeds(feeds).agg(F.min("next_fetch").alias("next_fetch"))


def feeds_with_unread(feeds: DataFrame, articles: DataFrame) -> DataFrame:
    """Listed feeds and their articles that are neither read nor archived."""
    unread = articles.filter(~F.col("is_read") & ~F.col("archived")).groupBy("feed_id").agg(F.count(F.lit(1)).alias("unread"))
    return feeds.filter(_listed()).join(unread, F.col("id") == F.col("feed_id"), "left").drop("feed_id").withColumn("unread", F.coalesce("unread", F.lit(0).cast("long"))).orderBy("id")


def feed_status(feeds: DataFrame) -> DataFrame:
    """Status words of the feed list: disabled before failing before ok; the title falls back to the address."""
    status = F.when(F.col("disabled"), "disabled").when(F.col("fail_count") > 0, F.concat(F.lit("failing("), F.col("fail_count").cast("string"), F.lit(")"))).otherwise("ok")
    return feeds.filter(_listed()).select("id", F.coalesce("title", "url").alias("title"), status.alias("status"))


def articles_for_feed(articles: DataFrame, feed_id: int) -> DataFrame:
    return articles.filter((F.col("feed_id") == feed_id) & ~F.col("archived")).orderBy(*newest())


def _hidden_id(feeds: DataFrame) -> DataFrame:
    return feeds.filter(~_listed()).select(F.col("id").alias("hidden_id"))


def web_clippings(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Articles of the hidden feed, archived ones included."""
    return articles.join(_hidden_id(feeds), F.col("feed_id") == F.col("hidden_id"), "left_semi").orderBy(*newest())


def saved_articles(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Not archived, and starred or a clipping."""
    rows = articles.filter(~F.col("archived")).join(_hidden_id(feeds), F.col("feed_id") == F.col("hidden_id"), "left")
    return rows.filter(F.col("starred") | F.col("hidden_id").isNotNull()).drop("hidden_id").orderBy(*newest())


def read_later_articles(articles: DataFrame) -> DataFrame:
    return articles.filter(~F.col("archived") & F.col("read_later")).orderBy(*newest())


def archived_articles(articles: DataFrame) -> DataFrame:
    return articles.filter("archived").orderBy(*newest())


def content_mode(mode: str, articles: DataFrame, feeds: DataFrame, feed_id: int | None = None) -> DataFrame:
    """The article list of a reading mode: feed, saved or read-later."""
    if mode == "feed":
        return articles_for_feed(articles, feed_id)
    return {"saved": lambda: saved_articles(articles, feeds), "read-later": lambda: read_later_articles(articles)}[mode]()


def library_counts(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """All counters of the side bar in one pass over the articles."""
    rows = articles.select("feed_id", "archived", "starred", "read_later", "is_read").join(_hidden_id(feeds), F.col("feed_id") == F.col("hidden_id"), "left")
    live = ~F.col("archived")
    return rows.agg(
        F.count_if(live & (F.col("starred") | F.col("hidden_id").isNotNull())).alias("saved"),
        F.count_if(live & F.col("read_later")).alias("read_later"),
        F.count_if("archived").alias("archived"),
        F.count_if(F.col("hidden_id").isNotNull()).alias("clippings"),
        F.count_if(live & ~F.col("is_read")).alias("unread"),
    )


def _noted() -> Column:
    return F.col("comment").isNotNull() & (F.length(F.trim("comment")) > 0)


def selections_for_article(selections: DataFrame, article_id: int) -> DataFrame:
    return selections.filter(F.col("article_id") == article_id).orderBy(F.desc("created_at"), F.desc("id"))


def favorite_selections(selections: DataFrame) -> DataFrame:
    return selections.filter("is_favorite").orderBy(F.desc("updated_at"), F.desc("id"))


def saved_selections(selections: DataFrame, articles: DataFrame) -> DataFrame:
    """Selections that are favourites or have a comment, with their article's feed and title."""
    from_article = articles.select(F.col("id").alias("article_id"), "feed_id", F.col("title").alias("article_title"))
    return selections.filter(F.col("is_favorite") | _noted()).join(from_article, "article_id").orderBy(F.desc("updated_at"), F.desc("id"))


def selection_counts(selections: DataFrame) -> DataFrame:
    return selections.agg(F.count_if(F.col("is_favorite") | _noted()).alias("saved"), F.count_if("is_favorite").alias("favorites"), F.count_if(_noted()).alias("thoughts"))


def tags_for_article(article_tags: DataFrame, tags: DataFrame, article_id: int | None = None) -> DataFrame:
    """(article_id, id, name) by name without regard to case; of one article or of all."""
    links = article_tags if article_id is None else article_tags.filter(F.col("article_id") == article_id)
    return links.join(tags, F.col("tag_id") == F.col("id")).select("article_id", "id", "name").orderBy("article_id", F.lower("name"))


# ---- state changes: each returns the table's next version


def set_flag(articles: DataFrame, ids: DataFrame, flag: str, value: bool | None, strict: bool = False) -> DataFrame:
    """Sets a flag of the articles in ids (column id); None toggles it. With strict an id that is not there is an error."""
    mark = ids.select(F.col("id").alias("marked")).distinct()
    if strict and not mark.join(articles, F.col("id") == F.col("marked"), "left_anti").isEmpty():
        raise KeyError("no such article")
    new = ~F.col(flag) if value is None else F.lit(value)
    return articles.join(mark, F.col("id") == F.col("marked"), "left").withColumn(flag, F.when(F.col("marked").isNotNull(), new).otherwise(F.col(flag))).drop("marked")


def apply_batch(articles: DataFrame, ids: DataFrame, action: str) -> DataFrame:
    """Archive, bookmark or read-later for many articles: sets the target state, never toggles."""
    return set_flag(articles, ids, {"archive": "archived", "bookmark": "starred", "read-later": "read_later"}[action], True)


def add_feed(feeds: DataFrame, urls: DataFrame, now: int) -> DataFrame:
    """Adds addresses (column url) that are not there yet, due at once."""
    top = feeds.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = urls.select("url").distinct().join(feeds, "url", "left_anti")
    new = number(new, ["url"]).crossJoin(F.broadcast(top)).select((F.col("n") + F.col("top")).alias("id"), "url", F.lit(now).cast("long").alias("next_fetch"))
    return feeds.unionByName(conform(new, "feeds"))


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with n = 1, 2, ... in the given order; the sorted rows are written once (see shared.numbered)."""
    return numbered(rows, [F.col(c) for c in order]).withColumn("n", F.col("n") + 1)


def remove_feed(target: str | int, feeds: DataFrame, articles: DataFrame, selections: DataFrame, article_tags: DataFrame, article_ai: DataFrame | None = None) -> dict[str, DataFrame]:
    """Removes a feed by id or address, never the hidden one, and all that hangs on it (article_ai too, if given)."""
    by_id = str(target).lstrip("-").isdigit()
    gone = feeds.filter((F.col("id") == int(target) if by_id else F.col("url") == target) & _listed()).select(F.col("id").alias("gone"))
    feeds2 = feeds.join(gone, F.col("id") == F.col("gone"), "left_anti")
    articles2 = articles.join(gone, F.col("feed_id") == F.col("gone"), "left_anti")
    dead = articles.join(gone, F.col("feed_id") == F.col("gone"), "left_semi").select(F.col("id").alias("dead"))
    on = F.col("article_id") == F.col("dead")
    out = {"feeds": feeds2, "articles": articles2, "article_selections": selections.join(dead, on, "left_anti"), "article_tags": article_tags.join(dead, on, "left_anti")}
    return out if article_ai is None else out | {"article_ai": article_ai.join(dead, on, "left_anti")}


def set_interval(feeds: DataFrame, feed_id: int, seconds: int) -> DataFrame:
    return feeds.withColumn("interval_secs", F.when(F.col("id") == feed_id, F.lit(seconds).cast("long")).otherwise(F.col("interval_secs")))


def set_disabled(feeds: DataFrame, feed_id: int, disabled: bool, now: int) -> DataFrame:
    """Enabling also clears the failure state and makes the feed due."""
    own = F.col("id") == feed_id
    out = feeds.withColumn("disabled", F.when(own, F.lit(disabled)).otherwise(F.col("disabled")))
    if not disabled:
        out = out.withColumn("fail_count", F.when(own, F.lit(0).cast("long")).otherwise(F.col("fail_count"))).withColumn("last_error", F.when(~own, F.col("last_error")))
        out = out.withColumn("next_fetch", F.when(own, F.lit(now).cast("long")).otherwise(F.col("next_fetch")))
    return out


def ensure_clippings_feed(feeds: DataFrame, now: int) -> DataFrame:
    """The hidden feed exists, is disabled and has no failure state."""
    own = ~_listed()
    fixed = feeds.withColumn("title", F.when(own, F.lit(CLIPPINGS_TITLE)).otherwise(F.col("title"))).withColumn("disabled", own | F.col("disabled"))
    fixed = fixed.withColumn("last_error", F.when(~own, F.col("last_error"))).withColumn("fail_count", F.when(own, F.lit(0).cast("long")).otherwise(F.col("fail_count")))
    top = feeds.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"), F.count_if(own).alias("there"))
    new = top.filter("there = 0").select((F.col("top") + 1).alias("id"), F.lit(CLIPPINGS_URL).alias("url"), F.lit(CLIPPINGS_TITLE).alias("title"), F.lit(now).cast("long").alias("next_fetch"), F.lit(True).alias("disabled"))
    return fixed.unionByName(conform(new, "feeds"))


def save_clippings(articles: DataFrame, feeds: DataFrame, pages: DataFrame, now: int) -> DataFrame:
    """Appends pages (url, title, html) as new rows of the hidden feed, each with a fresh entry id; blank html is refused."""
    blank = lambda c: F.when(F.length(F.trim(c)) > 0, F.trim(c))
    top = articles.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).crossJoin(_hidden_id(feeds))
    good = number(pages.filter(F.col("html").rlike(r"\S")), ["url", "html"])
    new = good.crossJoin(F.broadcast(top)).select(
        (F.col("top") + F.col("n")).alias("id"), F.col("hidden_id").alias("feed_id"), F.concat(F.lit("clip:"), F.replace(F.uuid(), F.lit("-"), F.lit(""))).alias("entry_id"), blank("url").alias("url"), blank("title").alias("title"),
        F.lit(CLIPPINGS_TITLE).alias("author"), F.lit(now).cast("long").alias("published"), F.col("html").alias("content"), F.lit(True).alias("is_read"), F.lit(True).alias("starred"), F.lit(now).cast("long").alias("fetched_at"),
    )
    return articles.unionByName(conform(new, "articles"))


def delete_clipping(articles: DataFrame, feeds: DataFrame, article_id: int) -> DataFrame:
    """Deletes an article only if it belongs to the hidden feed."""
    hit = articles.filter(F.col("id") == article_id).join(_hidden_id(feeds), F.col("feed_id") == F.col("hidden_id"), "left_semi").select(F.col("id").alias("gone"))
    return articles.join(hit, F.col("id") == F.col("gone"), "left_anti")


def normalize_tags(names: DataFrame) -> DataFrame:
    """(article_id, name): trimmed, not blank, one spelling for each name without regard to case."""
    rows = names.withColumn("name", F.regexp_replace("name", r"^\s+|\s+$", "")).filter(F.length("name") > 0)
    # without input order, the spelling that sorts last (small letters before capitals of a tie) stays
    return rows.groupBy("article_id", F.lower("name").alias("key")).agg(F.max("name").alias("name"))


def replace_tags(article_tags: DataFrame, tags: DataFrame, names: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Complete new tag sets of the articles in names (article_id, name); unused tags go. A stored spelling stays.

    An article that appears only with blank names loses all its tags.
    """
    wanted = normalize_tags(names)
    known = tags.select(F.lower("name").alias("key"), "id", "name", "created_at")
    fresh = wanted.groupBy("key").agg(F.max("name").alias("name")).join(known.select("key"), "key", "left_anti")
    top = tags.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = number(fresh, ["key"]).crossJoin(F.broadcast(top)).select("key", (F.col("top") + F.col("n")).alias("id"), "name", F.lit(now).cast("long").alias("created_at"))
    every = known.unionByName(fresh)
    links = wanted.select("article_id", "key").join(every.select("key", F.col("id").alias("tag_id")), "key").select("article_id", "tag_id", F.lit(now).cast("long").alias("created_at"))
    links = article_tags.join(names.select("article_id").distinct(), "article_id", "left_anti").unionByName(links)
    return links, every.drop("key").join(links.select(F.col("tag_id").alias("id")).distinct(), "id", "left_semi").select("id", "name", "created_at")


def orphan_tags(tags: DataFrame, article_tags: DataFrame) -> DataFrame:
    return tags.join(article_tags.select(F.col("tag_id").alias("id")), "id", "left_anti")


def split_tag_draft(draft: Column) -> Column:
    """Names of a typed tag list: split at commas (also the wide one) and newlines, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(draft, "[,，\n]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) > 0)


def article(articles: DataFrame, article_id: int) -> DataFrame:
    """The article of an id, or nothing."""
    return articles.filter(F.col("id") == article_id)


def feed(feeds: DataFrame, target: str | int) -> DataFrame:
    """The feed of an id or address, or nothing."""
    return feeds.filter(F.col("id") == int(target) if str(target).lstrip("-").isdigit() else F.col("url") == target)


def article_ai(stored: DataFrame, article_id: int) -> DataFrame:
    """Summary and translation of an article, or nothing."""
    return stored.filter(F.col("article_id") == article_id)


def check_selections(rows: DataFrame) -> DataFrame:
    """New selections trimmed and validated: `error` is null where a row may be stored.

    Text must not be blank, offsets must rise from 0, and a row marked as a comment needs one.
    """
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    text, note = trim("selected_text"), trim("comment")
    start, end = F.col("start_offset"), F.col("end_offset")
    wrong = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "blank text").when(start.isNotNull() & end.isNotNull() & ((start < 0) | (end < start)), "bad offsets")
    if "needs_comment" in rows.columns:
        wrong = wrong.when(F.col("needs_comment") & (F.coalesce(F.length(note), F.lit(0)) == 0), "blank comment")
    return rows.withColumn("error", wrong).withColumn("selected_text", text).withColumn("comment", F.when(F.length(note) > 0, note))


def update_selection(selections: DataFrame, selection_id: int, now: int, comment: str | None = None, favorite: bool | None = None, toggle: bool = False) -> DataFrame:
    """Changes a selection's comment (blank: none) or favourite mark, and its time."""
    own = F.col("id") == selection_id
    out = selections
    if comment is not None:
        out = out.withColumn("comment", F.when(own, F.lit(comment.strip() or None).cast("string")).otherwise(F.col("comment")))
    if favorite is not None or toggle:
        out = out.withColumn("is_favorite", F.when(own, ~F.col("is_favorite") if toggle else F.lit(favorite)).otherwise(F.col("is_favorite")))
    return out.withColumn("updated_at", F.when(own, F.lit(now).cast("long")).otherwise(F.col("updated_at")))


def delete_selection(selections: DataFrame, selection_id: int) -> DataFrame:
    return selections.filter(F.col("id") != selection_id)


def save_article_ai(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert of summaries by article: the new row wins as a whole."""
    return stored.join(rows.select("article_id"), "article_id", "left_anti").unionByName(rows.select(*stored.columns))
