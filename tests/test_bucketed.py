"""The bucketed store of articles: merges as the plain one does, touches no other bucket, shuffles no stored row."""

import random

import pytest
from pyspark.sql import functions as F

from lectern import bucketed
from lectern.bucketed import ArticleStore
from lectern.operators import feeds as ops
from lectern.schema import TABLES, conform
from lectern.shared import materialize
from lectern.tables import Conflict

ENTRY = "feed_id long, seq long, entry_id string, url string, title string, author string, published long, content string"


def entries(spark, rows):
    return spark.createDataFrame([(f, i, e, f"u{e}", t, None, 5, c) for i, (f, e, t, c) in enumerate(rows)], ENTRY)


def articles(spark, n=200):
    rows = spark.range(n).select((F.col("id") + 1).alias("id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 17).cast("long").alias("feed_id"), F.concat(F.lit("e"), "id").alias("entry_id"), F.lit("old").alias("title"), F.lit("text").alias("content"), F.lit(True).alias("starred"), F.lit(7).cast("long").alias("fetched_at"))
    return conform(rows, "articles")


def listed(df):
    return sorted(map(str, df.drop("id").collect()))


def test_merges_like_the_plain_one(spark, tmp_path):
    store = ArticleStore(spark, f"file://{tmp_path}/a", 16, 4)
    assert store.read().count() == 0
    assert {tuple(r) for r in store.merge(entries(spark, [(1, "x", "t", "c"), (1, "x", "u", ""), (2, "y", None, None)]), 1).collect()} == {(1, 1), (2, 1)}
    plain = articles(spark)
    store.load(plain)
    batches = [[(1, "e0", "new", "more"), (1, "e3", None, ""), (5, "e5", "n", "c"), (5, "z", "n", "c"), (5, "z", "m", "")], [(9, "q", "t", None), (1, "e0", "newer", None)], []]
    for k, batch in enumerate(batches):
        df, n = entries(spark, batch), plain.count()
        plain = spark.createDataFrame(ops.ingest(plain, df, 50 + k).collect(), TABLES["articles"])
        assert sum(r["inserted"] for r in store.merge(df, 50 + k).collect()) == plain.count() - n
        assert listed(store.read()) == listed(plain)
        # again: nothing changes
        assert store.merge(df, 50 + k).count() == 0 and listed(store.read()) == listed(plain)
    ids = [r["id"] for r in store.read().select("id").collect()]
    assert len(set(ids)) == len(ids)
    store.compact()
    assert listed(store.read()) == listed(plain)


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = ArticleStore(spark, f"file://{tmp_path}/a", 64, 4)
    store.load(articles(spark, 600))
    before = store.state()[1]["buckets"]
    batch = entries(spark, [(1, f"new{i}", "t", "c") for i in range(40)] + [(4, "e4", "t", "c")])
    touched = store.touched(batch)
    # a feed has as many buckets as slices at most, whatever number of entries came
    assert len(touched) <= 5 < len(before)
    store.merge(batch, 9)
    after = store.state()[1]["buckets"]
    assert {int(b) for b in after if before.get(b) != after[b]} == set(touched)


def test_stored_rows_are_not_shuffled(spark, tmp_path):
    store = ArticleStore(spark, f"file://{tmp_path}/a", 16, 4)
    store.load(articles(spark))
    batch = materialize(ops.fold_batch(entries(spark, [(1, "e0", "t", "c")])).withColumn("seq", F.lit(0)), "batch")
    number, state = store.state()
    plan = store._merged(state, batch, store.touched(batch), 9)._jdf.queryExecution().executedPlan().toString()
    stored = plan[: plan.index("Union") + plan[plan.index("Union") :].index("FileScan parquet")]
    assert "BroadcastHashJoin" in stored and "SortMergeJoin" not in plan


def test_texts_of_other_rows_stay_where_they_are(spark, tmp_path):
    """Where nothing is small enough to be broadcast by its size, no whole side is joined by its key, and no text is sorted for its number."""
    store = ArticleStore(spark, f"file://{tmp_path}/a", 8, 4)
    store.load(articles(spark))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(1, "e0", "new", "c"), *((5, f"n{i}", "t", "c") for i in range(20))]
        batch = materialize(ops.fold_batch(entries(spark, rows)).withColumn("seq", F.lit(0)), "batch")
        _, state = store.state()
        merged = store._merged(state, batch, store.touched(batch), 9)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert not any(x in line for line in plan.split("\n") if "SortMergeJoin [feed_id" in line for x in ("LeftOuter", "LeftAnti")) and "rangepartitioning" not in plan
        found = {r["entry_id"]: r for r in merged.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (found["e0"]["title"], found["e0"]["id"], found["e0"]["starred"]) == ("new", 1, True) and {r["title"] for e, r in found.items() if e[0] == "e" and e != "e0"} == {"old"}
    assert sorted(found[f"n{i}"]["id"] for i in range(20)) == list(range(201, 221))


def test_marks_by_place(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bucketed, "BLOCK", 16)
    rng = random.Random(3)
    for share in (0.0, 0.3, 1.0):
        path = f"{tmp_path}/rows-{share}"
        spark.range(150).repartition(3).write.parquet(path)
        rows = bucketed.placed(spark.read.parquet(path))
        chosen = [i for i in range(150) if rng.random() < share]
        got = bucketed.marked(rows, rows.filter(F.col("id").isin(chosen)).select("_file", "_block", "_at")).collect()
        assert sorted(r["id"] for r in got if r["_hit"]) == chosen and len(got) == 150
        assert sorted(r["_n"] for r in got if not r["_hit"]) == list(range(1, 151 - len(chosen)))


def test_an_empty_content_is_told_from_none(spark):
    rows = [(1, "a", "t", None), (1, "a", "t", ""), (1, "b", "t", ""), (1, "b", "t", None), (1, "c", "t", ""), (1, "c", "t", "x"), (1, "c", "t", None), (1, "d", "t", "y"), (1, "d", "t", "z")]
    assert {r["entry_id"]: r["content"] for r in ops.fold_batch(entries(spark, rows)).collect()} == {"a": None, "b": "", "c": "x", "d": "z"}


def test_of_two_merges_one_fails(spark, tmp_path):
    one, other = (ArticleStore(spark, f"file://{tmp_path}/a", 8, 2) for _ in range(2))
    one.load(articles(spark, 20))
    seen = other.state()
    one.merge(entries(spark, [(1, "a", "t", "c")]), 9)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(other, "state", lambda: seen)
        with pytest.raises(Conflict):
            other.merge(entries(spark, [(1, "b", "t", "c")]), 9)
    assert one.read().filter("entry_id in ('a', 'b')").count() == 1
