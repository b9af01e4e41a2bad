"""Feed ingest: entry normalisation, idempotent merge, back-off after failures, per-feed state.

The merge is one two-phase aggregate over the batch (folding repeats of an entry in batch order) and one full outer join
with stored articles by (feed_id, entry_id); no window gathers a feed's whole history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.library import number
from lectern.schema import conform


@dataclass(frozen=True)
class Policy:
    """Polling defaults, in seconds and failures."""

    interval: int = 900
    backoff_base: int = 60
    backoff_cap: int = 3600
    disable_after: int = 10


def backoff(failures: Column, policy: Policy) -> Column:
    """Seconds to wait after so many failures in a row: doubling from the base up to the cap."""
    doubled = F.lit(policy.backoff_base) * F.pow(F.lit(2.0), F.least(F.greatest(failures, F.lit(0)), F.lit(16)))
    return F.least(doubled, F.lit(float(policy.backoff_cap))).cast("long")


def entry_to_article(entries: DataFrame) -> DataFrame:
    """Normalised entries.

    entries: feed_id, seq, id, title, updated, published, content, summary, authors array<string>,
    links array<struct<href,rel,media_type>>, thumbnails array<string>, media array<struct<url,type>>.
    """
    links = F.coalesce(F.col("links"), F.array().cast("array<struct<href:string,rel:string,media_type:string>>"))
    alternate = F.filter(links, lambda x: x["rel"].isNull() | (x["rel"] == "alternate"))
    url = F.coalesce(F.get(alternate, 0)["href"], F.get(links, 0)["href"])
    body = F.coalesce(F.col("content"), F.col("summary"))
    pictures = F.concat(
        F.coalesce("thumbnails", F.array().cast("array<string>")),
        F.transform(F.filter(F.coalesce(F.col("media"), F.array().cast("array<struct<url:string,type:string>>")), lambda m: m["url"].isNotNull() & (m["type"].isNull() | m["type"].startswith("image/"))), lambda m: m["url"]),
        F.transform(F.filter(links, lambda x: x["media_type"].startswith("image/")), lambda x: x["href"]),
    )
    # a picture is appended only if its address is not in the text so far
    add = lambda acc, u: F.when(F.contains(acc, u), acc).otherwise(F.concat(acc, F.lit('\n<img src="'), F.replace(u, F.lit('"'), F.lit("&quot;")), F.lit('">')))
    content = F.when(body.isNull() & (F.size(pictures) == 0), F.lit(None)).otherwise(F.aggregate(pictures, F.coalesce(body, F.lit("")), add))
    blank = lambda c: F.when(F.length(c) > 0, c)
    return entries.select("feed_id", "seq", F.coalesce(blank(F.col("id")), url, F.col("title"), F.lit("")).alias("entry_id"), url.alias("url"), "title", F.get("authors", 0).alias("author"), F.coalesce("published", "updated").alias("published"), content.alias("content"))


def _last(column: str, usable: Column) -> Column:
    return F.max(F.when(usable, F.struct("seq", column)))[column]


def fold_batch(entries: DataFrame) -> DataFrame:
    """One row per (feed_id, entry_id): what inserting the first and updating with the rest, in seq order, comes to."""
    out = entries.groupBy("feed_id", "entry_id").agg(
        *(_last(c, F.col(c).isNotNull()).alias(c) for c in ("url", "title", "author", "published")),
        _last("content", F.length("content") > 0).alias("full"),
        # where no content is filled, the first one tells null from empty; a filled one is not sent a second time
        F.min(F.struct("seq", F.when(F.length("content") == 0, F.col("content")).alias("content")))["content"].alias("first"),
    )
    return out.withColumn("content", F.coalesce("full", "first")).drop("full", "first")


def ingest(articles: DataFrame, entries: DataFrame, now: int) -> DataFrame:
    """Articles after a batch (feed_id, seq, entry_id, url, title, author, published, content).

    New keys are inserted; of known ones filled fields are refreshed, an empty content never replaces one, and the
    reader's flags and fetched_at stay.
    """
    known = refreshed(articles, fold_batch(entries), "left")
    new = number(inserted(articles, entries), ["feed_id", "entry_id"])
    highest = F.broadcast(articles.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")))
    new = new.crossJoin(highest).withColumn("id", F.col("top") + F.col("n"))
    return known.unionByName(created(new, now))


def refreshed(articles: DataFrame, batch: DataFrame, how: str) -> DataFrame:
    """Articles joined with a folded batch: filled fields of the batch replace theirs."""
    batch = batch.select(F.col("feed_id").alias("b_feed"), F.col("entry_id").alias("b_entry"), *(F.col(c).alias(f"b_{c}") for c in ("url", "title", "author", "published", "content")))
    known = articles.join(batch, (F.col("feed_id") == F.col("b_feed")) & (F.col("entry_id") == F.col("b_entry")), how)
    fields = {c: F.coalesce(F.col(f"b_{c}"), F.col(c)) for c in ("url", "title", "author", "published")}
    fields["content"] = F.when(F.length("b_content") > 0, F.col("b_content")).otherwise(F.col("content"))
    return known.withColumns(fields).select(*articles.columns)


def created(new: DataFrame, now: int) -> DataFrame:
    """New articles of a folded batch whose rows have their ids."""
    return conform(new.withColumn("fetched_at", F.lit(now).cast("long")), "articles")


def inserted(articles: DataFrame, entries: DataFrame) -> DataFrame:
    """The batch's truly new articles."""
    return fold_batch(entries).join(articles.select("feed_id", "entry_id"), ["feed_id", "entry_id"], "left_anti")


def record_success(feeds: DataFrame, done: DataFrame, now: int, policy: Policy = Policy()) -> DataFrame:
    """Feeds after successful fetches (feed_id, title). `disabled` is left as it is."""
    ok = done.groupBy("feed_id").agg(F.max("title").alias("new_title"))
    rows = feeds.join(ok, F.col("id") == F.col("feed_id"), "left")
    hit = F.col("feed_id").isNotNull()
    return rows.withColumns({
        "title": F.when(hit, F.coalesce("title", "new_title")).otherwise(F.col("title")), "last_fetch": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("last_fetch")),
        "next_fetch": F.when(hit, now + F.coalesce("interval_secs", F.lit(policy.interval))).otherwise(F.col("next_fetch")).cast("long"), "fail_count": F.when(hit, F.lit(0).cast("long")).otherwise(F.col("fail_count")),
        "last_error": F.when(~hit, F.col("last_error")),
    }).select(*feeds.columns)


def record_failure(feeds: DataFrame, failed: DataFrame, now: int, policy: Policy = Policy()) -> DataFrame:
    """Feeds after failed fetches (feed_id, error). `disabled` becomes whether the threshold is reached, either way."""
    bad = failed.groupBy("feed_id").agg(F.max("error").alias("error"))
    rows = feeds.join(bad, F.col("id") == F.col("feed_id"), "left")
    hit = F.col("feed_id").isNotNull()
    count = F.col("fail_count") + 1
    return rows.withColumns({
        "next_fetch": F.when(hit, now + backoff(count, policy)).otherwise(F.col("next_fetch")), "disabled": F.when(hit, count >= policy.disable_after).otherwise(F.col("disabled")),
        "last_error": F.when(hit, F.col("error")).otherwise(F.col("last_error")), "fail_count": F.when(hit, count).otherwise(F.col("fail_count")),
    }).select(*feeds.columns)


def backoff_schedule(feeds: DataFrame, now: int, policy: Policy = Policy()) -> DataFrame:
    """What one more failure would bring each listed, enabled feed."""
    count = F.col("fail_count") + 1
    return feeds.filter(~F.col("disabled")).select("id", count.alias("fail_count"), backoff(count, policy).alias("delay"), (now + backoff(count, policy)).alias("next_fetch"), (count >= policy.disable_after).alias("disabled"))


def failure_state(log: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """State of each feed after its log (feed_id, at, seq, ok): failures in a row, longest run, whether it is disabled.

    The batch twin of streaming.state: runs of failures are the stretches between successes.
    """
    order = Window.partitionBy("feed_id").orderBy("at", "seq")
    runs = log.withColumn("run", F.sum(F.col("ok").cast("int")).over(order))
    runs = runs.groupBy("feed_id", "run").agg(F.count_if(~F.col("ok")).alias("failures"), F.max(F.when(~F.col("ok"), F.struct("at", "seq"))).alias("failed"))
    last = F.max(F.struct("run", "failures"))
    # the disabled mark is what the last failure left; a success does not clear it
    mark = F.max(F.when(F.col("failed").isNotNull(), F.struct("failed", "failures")))
    return runs.groupBy("feed_id").agg(last["failures"].alias("fail_count"), F.max("failures").alias("longest"), (F.coalesce(mark["failures"], F.lit(0)) >= policy.disable_after).alias("disabled"))


def round_totals(results: DataFrame) -> DataFrame:
    """Totals of a fetch round (feed_id, inserted): feeds with something new, and how many new articles."""
    return results.agg(F.count_if(F.col("inserted") > 0).alias("feeds"), F.coalesce(F.sum("inserted"), F.lit(0)).cast("long").alias("articles"))


def notification(totals: DataFrame, enabled: bool = True, focused: bool = False) -> DataFrame:
    """The totals, if anybody is to be told of them."""
    return totals.filter((F.col("articles") > 0) & F.lit(enabled and not focused))
