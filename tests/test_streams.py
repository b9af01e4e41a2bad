"""Polling timers and bounded de-duplication, with assertions on the state that streams leave."""

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from lectern.operators import feeds as ops
from lectern.streaming import ingest, timers
from lectern.tables import Library


def poll(spark, root, policy=ops.Policy()):
    query = timers.start_polling(spark.readStream.schema(timers.EVENT).parquet(f"{root}/events"), f"{root}/log", f"{root}/cp", policy, once=True)
    assert query.awaitTermination(120)
    return {tuple(r) for r in spark.read.schema(timers.LOG).parquet(f"{root}/log").collect()}


def tell(spark, root, rows):
    spark.createDataFrame(rows, timers.EVENT).coalesce(1).write.mode("append").parquet(f"{root}/events")


def test_timers_tell_what_is_due(spark, tmp_path):
    root = f"file://{tmp_path}"
    far = 4_000_000_000  # not due in this century
    tell(spark, root, [(1, 100, 0, "listed", 600, 50, 0), (2, 100, 0, "listed", None, None, 2), (3, 100, 0, "listed", None, 200, 0), (3, 100, 1, "disabled", None, None, None), (4, 100, 0, "listed", None, far, 0)])
    first = {(1, "scheduled", 50, 0, False), (1, "due", 50, 0, False), (2, "scheduled", 100, 2, False), (2, "due", 100, 2, False), (3, "stopped", 200, 0, True), (4, "scheduled", far, 0, False)}
    assert poll(spark, root) == first
    # a restart finds state and timers; a success and a failure in one batch count in their order, the earlier timer of 4 is gone
    tell(spark, root, [(1, 300, 2, "failed", None, None, None), (1, 290, 1, "ok", None, None, None), (2, 300, 3, "failed", None, None, None), (3, 300, 0, "enabled", None, None, None), (4, 300, 0, "ok", None, None, None)])
    second = {(1, "scheduled", 420, 1, False), (1, "due", 420, 1, False), (2, "stopped", 300 + 480, 3, True), (3, "scheduled", 200, 0, False), (3, "due", 200, 0, False), (4, "scheduled", 1200, 0, False), (4, "due", 1200, 0, False)}
    policy = ops.Policy(disable_after=3)
    assert poll(spark, root, policy) == first | second
    got = {tuple(r) for r in timers.feed_state(spark, f"{root}/cp").collect()}
    assert got == {(1, 1, 600, 420, False), (2, 3, None, 780, True), (3, 0, None, 200, False), (4, 0, None, 1200, False)}
    # nothing new: nothing is told twice
    assert poll(spark, root, policy) == first | second


def test_repeats_are_dropped_with_bounded_state(spark, tmp_path):
    """Forty days of entries, each sent twice within a day; one of the first day comes again at the end."""
    root, start = f"file://{tmp_path}", datetime(2024, 1, 1, tzinfo=UTC)
    schema = "feed_id long, entry_id string, seen timestamp"
    begin = lambda: ingest.distinct_entries(spark.readStream.schema(schema).parquet(f"{root}/in"), "seen").writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
    most = 0
    for step in range(8):
        days = range(5 * step, 5 * step + 5)
        rows = [(1, f"e{d}-{k}", start + timedelta(days=d, hours=h)) for d in days for k in range(10) for h in (0, 6)]
        rows += [(1, "e0-0", start + timedelta(days=39))] if step == 7 else []
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        query = begin()
        assert query.awaitTermination(120)
        most = max(most, query.lastProgress["stateOperators"][0]["numRowsTotal"])
    sent = [r["entry_id"] for r in spark.read.parquet(f"{root}/out").collect()]
    # of 400 keys a few days' are held; the late repeat passes
    assert most <= 120 and len(sent) == 401 and sent.count("e0-0") == 2 and len(set(sent)) == 400
    # the merge takes it in once
    library = Library(spark, f"{root}/lib")
    again = spark.createDataFrame([(1, i, e, "t", "c") for i, e in enumerate(sent)], "feed_id long, seq long, entry_id string, title string, content string").withColumns({"url": F.lit(None).cast("string"), "author": F.lit(None).cast("string"), "published": F.lit(None).cast("long")})
    assert ops.ingest(library.read("articles"), again, 5).count() == 400
