"""Structured Streaming: micro-batch ingest of payloads, and per-feed failure state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators import feeds as ops
from lectern.operators import library as lib
from lectern.shared import materialize
from lectern.sources.payloads import decoded_feeds, fetch, http_get, parse_feeds
from lectern.tables import Library

STATE = "feed_id long, fail_count long, longest long, disabled boolean"


def ingest_batch(library: Library, payloads: DataFrame, now: int, policy: ops.Policy = ops.Policy()) -> DataFrame:
    """One round: payloads (feed_id, payload, error) into articles and feeds. Returns (feed_id, inserted) of the round.

    Payloads are parsed once; a failed feed only changes its own row.
    """
    entries = parse_feeds(payloads).persist()
    try:
        articles, feeds = library.read("articles"), library.read("feeds")
        good = entries.filter("error is null")
        # several payloads of one feed in a batch count in their order of entries
        new = ops.entry_to_article(good.filter("seq is not null"))
        # counted before the articles are replaced
        counts = materialize(ops.inserted(articles, new).groupBy("feed_id").agg(F.count(F.lit(1)).alias("inserted")), "inserted")
        feeds = ops.record_success(feeds, good.select("feed_id", F.col("feed_title").alias("title")), now, policy)
        feeds = ops.record_failure(feeds, entries.filter("error is not null").select("feed_id", "error"), now, policy)
        library.write(articles=ops.ingest(articles, new, now), feeds=feeds)
        return counts
    finally:
        entries.unpersist()


def fetch_round(library: Library, feeds: DataFrame, now: int, get: Callable = http_get, at_once: int = 16, policy: ops.Policy = ops.Policy()) -> DataFrame:
    """Fetches feeds (id, url), at most at_once at a time, and ingests what they send: one row of totals (feeds, articles)."""
    asked = feeds.select(F.col("id").alias("feed_id"), "url").repartition(at_once, "feed_id")
    got = decoded_feeds(fetch(asked, get).select("feed_id", "body", "content_type", "error")).select("feed_id", "payload", "error")
    return ops.round_totals(ingest_batch(library, got, now, policy))


def update_once(library: Library, now: int, get: Callable = http_get, policy: ops.Policy = ops.Policy()) -> DataFrame:
    """A round over all enabled feeds, due or not."""
    return fetch_round(library, lib.enabled_feeds(library.read("feeds")), now, get, policy=policy)


# Seconds that a scheduler waits at least.
LEAST_WAIT = 5


def next_wait(feeds: DataFrame, now: int, policy: ops.Policy = ops.Policy()) -> DataFrame:
    """(wait): seconds until the earliest enabled feed is due, from LEAST_WAIT to the polling interval."""
    most = max(LEAST_WAIT, policy.interval)
    due = F.coalesce(F.col("next_fetch") - now, F.lit(most))
    return lib.earliest_next_fetch(feeds).select(F.greatest(F.lit(LEAST_WAIT), F.least(due, F.lit(most))).cast("long").alias("wait"))


def schedule(library: Library, get: Callable, clock: Callable[[], int], sleep: Callable[[float], None], rounds: int, policy: ops.Policy = ops.Policy()) -> list[int]:
    """So many rounds over the due feeds with a wait after each; returns the waits. sleep may return early to wake it up."""
    waits = []
    for _ in range(rounds):
        now = clock()
        due = lib.due_feeds(library.read("feeds"), now)
        if not due.isEmpty():
            fetch_round(library, due, now, get, policy=policy).collect()
        waits.append(next_wait(library.read("feeds"), clock(), policy).first()["wait"])
        sleep(waits[-1])
    return waits


def start_ingest(stream: DataFrame, library: Library, checkpoint: str, clock, policy: ops.Policy = ops.Policy(), **trigger) -> StreamingQuery:
    """Ingests a stream of payloads batch by batch. A batch that runs again changes nothing: the merge is idempotent."""
    return stream.writeStream.foreachBatch(lambda df, _: ingest_batch(library, df, clock(), policy) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def failure_state(log: DataFrame, disable_after: int = 10) -> DataFrame:
    """Streaming twin of operators.feeds.failure_state: state of each feed after every batch of its log.

    log: feed_id, at, seq, ok. Within a batch events are taken by (at, seq); events of a later batch come after them.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, longest, disabled = state.get if state.exists else (0, 0, False)
        for row in pd.concat(list(frames)).sort_values(["at", "seq"]).itertuples():
            if row.ok:
                count = 0
            else:
                count += 1
                longest, disabled = max(longest, count), count >= disable_after
        state.update((int(count), int(longest), bool(disabled)))
        yield pd.DataFrame([(key[0], count, longest, disabled)], columns=["feed_id", "fail_count", "longest", "disabled"])

    return log.groupBy("feed_id").applyInPandasWithState(step, STATE, "fail_count long, longest long, disabled boolean", "update", GroupStateTimeout.NoTimeout)


def distinct_entries(stream: DataFrame, seen: str | None = None, within: str = "2 days") -> DataFrame:
    """The first row of each entry key. With a time column `seen`, keys are remembered for `within` after their first row, so
    state stays bounded; a repeat that comes later passes, and the merge, which is idempotent, takes it in once. Without
    one, keys are remembered over the life of the stream."""
    keys = ["feed_id", "entry_id"]
    return stream.dropDuplicates(keys) if seen is None else stream.withWatermark(seen, within).dropDuplicatesWithinWatermark(keys)
