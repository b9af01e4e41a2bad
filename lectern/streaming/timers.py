"""Polling as keyed state with timers: a stream of fetch results goes in, a log of what is scheduled and what is due comes out.

Each feed has one value of state (failures in a row, its interval, when it is due, whether it is disabled) and at most one
timer, which is set to the time at which the feed is due: the interval after a success, the back-off after a failure. When a
timer expires the feed is due and the log says so; nothing waits on the driver, and a restart from the checkpoint finds all
timers again. State lives in RocksDB and can be read from outside through Spark's state data source.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lectern.operators.feeds import Policy

#: kind: `listed` (with next_fetch and fail_count as they are known), `ok`, `failed`, `enabled` or `disabled`.
EVENT = "feed_id long, at long, seq long, kind string, interval_secs long, next_fetch long, fail_count long"
STATE = "fail_count long, interval_secs long, next_fetch long, disabled boolean"
#: what: `scheduled` (due at `at` from now on), `due`, or `stopped`.
LOG = "feed_id long, what string, at long, fail_count long, disabled boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _number(value: Any) -> int | None:
    return None if value is None or pd.isna(value) else int(value)


class FeedTimers(StatefulProcessor):
    """State and timer of one feed."""

    def __init__(self, policy: Policy) -> None:
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.feed = handle.getValueState("feed", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fails, interval, due, disabled = self.feed.get() if self.feed.exists() else (0, None, None, False)
        before = due
        for event in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples():
            interval = _number(event.interval_secs) if event.kind == "listed" else interval
            if event.kind == "listed":
                fails, due = _number(event.fail_count) or 0, _number(event.next_fetch)
                due = int(event.at) if due is None else due
            elif event.kind == "ok":
                fails, due = 0, int(event.at) + (self.policy.interval if interval is None else interval)
            elif event.kind == "failed":
                fails += 1
                # as operators.feeds.backoff
                due = int(event.at) + min(self.policy.backoff_base * 2 ** min(fails, 16), self.policy.backoff_cap)
                disabled = fails >= self.policy.disable_after
            else:
                disabled = event.kind == "disabled"
        self.feed.update((fails, interval, due, disabled))
        if before is not None:
            self.handle.deleteTimer(before * 1000)
        if disabled or due is None:
            yield pd.DataFrame([(key[0], "stopped", due, fails, disabled)], columns=COLUMNS)
            return
        self.handle.registerTimer(due * 1000)
        yield pd.DataFrame([(key[0], "scheduled", due, fails, disabled)], columns=COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fails, _, due, disabled = self.feed.get()
        if not disabled and due * 1000 == expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame([(key[0], "due", due, fails, disabled)], columns=COLUMNS)

    def close(self) -> None:
        pass


COLUMNS = ["feed_id", "what", "at", "fail_count", "disabled"]


def use_rocksdb(spark: SparkSession) -> None:
    """State of this session's streams in RocksDB, which timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def poll_log(events: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The log (LOG) of a stream of events (EVENT), by the clock of the machine."""
    use_rocksdb(events.sparkSession)
    return events.groupBy("feed_id").transformWithStateInPandas(FeedTimers(policy), LOG, "Append", "ProcessingTime")


def listed(feeds: DataFrame, at: int) -> DataFrame:
    """Events that make a library's enabled feeds known."""
    return feeds.filter(~F.col("disabled")).select(F.col("id").alias("feed_id"), F.lit(at).cast("long").alias("at"), F.lit(0).cast("long").alias("seq"), F.lit("listed").alias("kind"), "interval_secs", "next_fetch", F.col("fail_count").cast("long").alias("fail_count"))


def start_polling(events: DataFrame, log: str, checkpoint: str, policy: Policy = Policy(), once: bool = False) -> StreamingQuery:
    """Appends the log to a Parquet folder, exactly once, second by second; once: ends when all events are taken up, with the
    timers that have expired by then."""
    spark = events.sparkSession
    # with timers of the clock there is always another batch to come, so a run that shall end must wait for data
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(not once).lower())
    out = poll_log(events, policy).writeStream.outputMode("append").format("parquet").option("path", log).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="1 second")).start()


def feed_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(feed_id, fail_count, interval_secs, next_fetch, disabled) that a stream's last batch left, from its checkpoint."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "feed").load()
    return rows.select("key.feed_id", "value.*")
