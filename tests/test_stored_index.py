"""The stored index: results as of a scan, deltas as of a rebuild, only its buckets read, few blocks opened."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import search
from lectern.operators.stored_index import StoredIndex, touched

ROW = "kind int, source_id long, article_id long, feed_id long, title string, body string, snippet string, timestamp long, archived boolean"


def rows(spark, n=120, seed=1):
    rng = random.Random(seed)
    words = ["license", "public", "Version", "versionen", "Straße", "naïve", "aaaa", "x", "ab", "the", "\n", "🙂🙂🙂", "über"] + ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    out = [(rng.randrange(4), i, i // 2, i % 5, f"t{i}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), None, 1000 + i % 7, i % 9 == 0) for i in range(n)]
    out += [(0, 900, 450, 1, None, None, None, 5, False), (0, 901, 450, 1, None, "", None, None, None), (0, 902, 451, 1, "", "ab", None, 5, False), (0, 903, 452, 1, "", "license " * 3000, None, 5, False)]
    return spark.createDataFrame(out, ROW)


def listed(df):
    return [tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.orderBy("query_id", "rank").collect()]


QUERIES = {1: "license public", 2: "aaa", 3: "straße", 4: "VERSION naïve", 5: "aaaa the", 6: "nowhere", 7: "🙂🙂🙂"}


def test_results_are_those_of_a_scan(spark, tmp_path):
    df = rows(spark)
    for block_rows in (7, 512):
        index = StoredIndex(spark, f"file://{tmp_path}/i{block_rows}", 8, block_rows)
        index.build(df.repartition(3))
        for limit in (1, 5, 500):
            assert listed(index.search(QUERIES, limit)) == listed(search.bm25(df, QUERIES, limit))
        assert index.search(QUERIES, 0).count() == 0 and index.search({}, 5).count() == 0
        with pytest.raises(ValueError):
            index.search({1: "ab license"}, 5)


def test_deltas_equal_a_rebuild(spark, tmp_path):
    old, new = rows(spark), rows(spark, 140, 2).filter("source_id % 10 <> 3")
    changed = F.col("source_id") % 3 == 0
    kept = old.filter(~changed).unionByName(new.filter(changed))
    keys = old.filter(changed).select("kind", "source_id").unionByName(new.filter(changed).select("kind", "source_id"))
    index, again = (StoredIndex(spark, f"file://{tmp_path}/{n}", 8, 7) for n in ("delta", "whole"))
    with pytest.raises(ValueError):
        index.update(keys, kept)
    index.build(old)
    index.update(keys, kept)
    # one more delta over the first one's rows, with a key that is gone
    last = kept.filter("source_id <> 6").withColumn("body", F.when(F.col("source_id") == 9, F.lit("licensed aaaaa")).otherwise(F.col("body")))
    index.update(kept.filter("source_id in (6, 9)").select("kind", "source_id"), last)
    again.build(last)
    for one in (lambda i: i.trigram_counts(), lambda i: i.rows()):
        assert sorted(map(str, one(index).collect())) == sorted(map(str, one(again).collect()))
    assert index.pointers.state()[1]["rows"] == last.count()
    assert listed(index.search(QUERIES, 6)) == listed(again.search(QUERIES, 6)) == listed(search.bm25(last, QUERIES, 6))
    before = index.pointers.folders(("segment-", "dead-"))
    index.compact(last)
    assert len(before) == 5 and len(index.pointers.state()[1]["segments"]) == 1
    assert listed(index.search(QUERIES, 6)) == listed(again.search(QUERIES, 6))


def test_a_search_opens_only_its_buckets(spark, tmp_path):
    index = StoredIndex(spark, f"file://{tmp_path}/i", 32, 7)
    index.build(rows(spark))
    found = index.matching(["license"])
    run = found._jdf.queryExecution()
    assert run.toRdd().count() > 0
    scan = run.executedPlan().collectLeaves().head()
    files = len(list((tmp_path / "i").rglob("*.parquet")))
    buckets = {r["bucket"] for r in found.select("bucket").collect()}
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN", run.toString()) and "In(trigram" in run.toString()
    assert scan.metrics().apply("numFiles").value() == len(buckets) <= 5 < files and -1 not in buckets


def test_blocks_out_of_reach_are_not_opened(spark, tmp_path):
    """Of 50 blocks with the term, the one that has it often holds the best rows; no other is opened."""
    data = [(0, i, i, 1, "t", "license " * (40 if 8 <= i < 12 else 1) + "filler " * (1 if 8 <= i < 12 else 60), None, i, False) for i in range(200)] + [(0, 1000 + i, 0, 1, "t", "other text", None, 0, False) for i in range(400)]
    df = spark.createDataFrame(data, ROW).coalesce(1)
    index = StoredIndex(spark, f"file://{tmp_path}/i", 8, 4)
    index.build(df)
    counts = [r for r in index.partial({1: "license"}, 4).collect() if r["ord"] == -1]
    assert sum(r["block"] for r in counts) == 50 and sum(r["score"] for r in counts) == 1
    assert listed(index.search({1: "license"}, 4)) == listed(search.bm25(df, {1: "license"}, 4))


def test_touched_keys(spark):
    articles = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "id long, feed_id long")
    selections, links = spark.createDataFrame([(7, 1), (8, 3)], "id long, article_id long"), spark.createDataFrame([(3, 5)], "article_id long, tag_id long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    keys = lambda **k: {tuple(r) for r in touched(articles, selections, links, **k).collect()}
    assert keys(article_ids=ids(1)) == {(0, 1), (1, 1), (2, 7), (3, 7)}
    assert keys(tag_ids=ids(5)) == {(0, 3), (1, 3), (2, 8), (3, 8)} and keys(selection_ids=ids(9)) == {(2, 9), (3, 9)}
    assert keys(feed_ids=ids(10)) == {(k, i) for k in (0, 1) for i in (1, 2)} | {(2, 7), (3, 7)}


def test_an_empty_index(spark, tmp_path):
    index = StoredIndex(spark, f"file://{tmp_path}/i")
    assert index.search({1: "license"}, 5).count() == 0
    index.build(rows(spark).limit(0))
    assert index.search({1: "license"}, 5).count() == 0 and index.rows().count() == 0
    index.update(rows(spark).select("kind", "source_id"), rows(spark))
    assert listed(index.search({1: "license"}, 5)) == listed(search.bm25(rows(spark), {1: "license"}, 5))


def test_entries_take_few_bytes(spark):
    """Numbers of all lengths come back from their bytes; a long text's entries are a small multiple of it."""
    import numpy as np

    from lectern.operators import stored_index as st

    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 28) - 1, 1 << 28, (1 << 35) - 1, 5], np.int64)
    data, begins = st._pack(values)
    assert st._unpack(data).tolist() == values.tolist() and begins[-1] == len(data)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(40)] + ["", None, "ab", "abc"]
    doc = dict.fromkeys(st._FIELDS)
    batch = st.block_postings(texts, [doc] * len(texts), 7)
    assert batch.nbytes < 5 * sum(len(t or "") for t in texts)
    own = batch.slice(1)
    n, held, row, tf, size, pos = st._entries(own)
    grams = [g for g, k in zip(own.column("trigram").to_pylist(), held) for _ in range(k)]
    ords = [r for r, k in zip(row.tolist(), tf) for _ in range(k)]
    assert sorted(zip(ords, pos.tolist(), grams)) == sorted((i, p, t[p : p + 3]) for i, t in enumerate(texts) if t for p in range(len(t) - 2))
    assert [len(texts[i]) - 2 for i in row] == size.tolist() and n.sum() == len(row)


def test_texts_are_not_dealt_by_feed(spark):
    """A feed may hold most of the articles: feeds go to the articles, whatever size they are thought to have."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        articles = spark.createDataFrame([(1, 0, "t", None, "c", None, None, 5, False)], "id long, feed_id long, title string, author string, content string, url string, published long, fetched_at long, archived boolean")
        feeds = spark.createDataFrame([(0, "u")], "id long, url string")
        marks = spark.createDataFrame([], "id long, article_id long, selected_text string, comment string, is_favorite boolean, updated_at long")
        got = search.index_rows(articles, feeds, marks, spark.createDataFrame([], "article_id long, tag_id long"), spark.createDataFrame([], "id long, name string"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == 1 and "hashpartitioning(feed_id" not in plan and "BroadcastHashJoin [feed_id" in plan
    finally:
        spark.conf.set(key, old)


def test_postings_cross_no_shuffle(spark, tmp_path):
    """Each file holds the blocks of the task that cut them; the join with dead rows sends no postings either."""
    df = rows(spark)
    key, freed = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old, kept = spark.conf.get(key), spark.conf.get(freed)
    spark.conf.set(key, -1)
    try:
        index, again = (StoredIndex(spark, f"file://{tmp_path}/{n}", 8, 7) for n in ("i", "again"))
        index.build(df.repartition(3), in_place=True)
        again.build(df)
        changed = df.filter("source_id % 3 = 0").withColumn("body", F.reverse("body"))
        index.update(changed.select("kind", "source_id"), changed.repartition(2), narrowed=True, in_place=True)
        now = df.filter("source_id % 3 <> 0").unionByName(changed)
        again.update(changed.select("kind", "source_id"), now)
        for segment in index._state()["segments"]:
            tasks = spark.read.parquet(f"{index.root}/{segment}").groupBy(F.input_file_name()).agg(F.count_distinct(F.shiftright("block", 32)).alias("n"))
            assert tasks.filter("n > 1").count() == 0
            assert len(list((tmp_path / "i" / segment / "bucket=-1").glob("part-*"))) > 1
        plan = index.trigram_counts()._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(map(tuple, index.trigram_counts().collect())) == sorted(map(tuple, again.trigram_counts().collect()))
        assert listed(index.search(QUERIES, 6)) == listed(again.search(QUERIES, 6)) == listed(search.bm25(now, QUERIES, 6))
        assert spark.conf.get(freed) == kept
    finally:
        spark.conf.set(key, old)


def test_parts_of_index_rows(spark):
    """Articles and passages apart are the rows together."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        articles = spark.createDataFrame([(i, i % 2, f"t{i}", None, f"c{i}", None, None, 5, False) for i in range(9)], "id long, feed_id long, title string, author string, content string, url string, published long, fetched_at long, archived boolean")
        feeds = spark.createDataFrame([(0, "u"), (1, "v")], "id long, url string")
        marks = spark.createDataFrame([(1, 3, "s", None, True, 7), (2, 4, "s", "note", False, 8), (3, 99, "s", "note", True, 8)], "id long, article_id long, selected_text string, comment string, is_favorite boolean, updated_at long")
        links, tags = spark.createDataFrame([(3, 1), (3, 2)], "article_id long, tag_id long"), spark.createDataFrame([(1, "b"), (2, "A")], "id long, name string")
        own, parts = search.article_rows(articles, feeds, links, tags), search.passage_rows(articles, marks)
        both = sorted(map(str, own.collect() + parts.collect()))
        assert both == sorted(map(str, search.index_rows(articles, feeds, marks, links, tags).collect())) and len(both) == 11
        assert {r["body"] for r in own.collect() if r["source_id"] in (3, 4)} == {"t3\n\nc3\n\nA b", "t4\n\nc4\n\n"}
    finally:
        spark.conf.set(key, old)


def test_numbers_of_one_kind_lie_together(spark, tmp_path):
    """Each kind of number is a column, so counts over changed rows read no sizes and no places."""
    from lectern.operators import stored_index as st

    index = StoredIndex(spark, f"file://{tmp_path}/i", 8, 7)
    index.build(rows(spark))
    index.update(rows(spark).filter("source_id = 3").select("kind", "source_id"), rows(spark))
    plan = index.trigram_counts()._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"FileScan parquet \[trigram#\d+,block#\d+L,n#\d+,held#\d+,gaps#\d+,times#\d+,bucket#\d+\]", plan)
    doc = dict.fromkeys(st._FIELDS)
    batch = st.block_postings(["aaaa" * 20000, "xyz aaa", None], [doc] * 3, 1).slice(1)
    n, held, row, tf, size, pos = st._entries(batch)
    own = {g: (n[i], held[i]) for i, g in enumerate(batch.column("trigram").to_pylist())}
    assert own["aaa"] == (2, 79999) and own["xyz"] == (1, 1) and sum(tf) == len(pos) == 79998 + 5
    # a trigram that stands at each place takes two bytes for each; a single one a byte for its row, none for how often
    assert sum(len(st._bytes(batch.column(c))) for c in st.NUMBERS) < 2.1 * 80_000
    assert st._bytes(batch.column("times")).tolist() == st._pack(st.np.array([79998 - 2]))[0].tolist()


def test_texts_are_dealt_once_by_id(spark):
    """Labels and tags meet the articles where one shuffle by id has brought them; titles come without their texts."""
    from lectern.sources.domain import Domain

    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        d = Domain(spark, "/root/testdata/sf0.001")
        plan = search.article_rows(d.articles(), d.feeds(), d.article_tags(), d.tags())._jdf.queryExecution().executedPlan().toString()
        # the articles and their labels
        assert len(re.findall(r"Exchange hashpartitioning\((?:id|doc_id)#", plan)) == 2
    finally:
        spark.conf.set(key, old)
    labels = {r["doc_id"]: r for r in d.raw("labels").collect()}
    got = {r["id"]: r for r in d.articles().select("id", "feed_id", "starred", "archived").collect()}
    assert len(got) == d.raw("documents").count() + d.raw("pages").count()
    for i, r in got.items():
        mark = labels.get(i) if r["feed_id"] else None
        assert (r["starred"], r["archived"]) == ((not r["feed_id"]) or (mark is not None and mark["quality"] == 1), mark is not None and mark["toxic"] == 1)
