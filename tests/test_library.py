"""State changes and views on small tables, with the behaviour that a reader relies on."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import patterns
from lectern.operators import anchors, blobcache, feeds, library, search
from lectern.schema import CLIPPINGS_URL, TABLES, conform, violations

ENTRY = "feed_id long, seq long, entry_id string, url string, title string, author string, published long, content string"


def table(spark, name, rows):
    """Rows of a library table given as dicts; missing columns get their defaults."""
    fields = [f for f in TABLES[name].fields if any(f.name in r for r in rows)]
    if not rows:
        return spark.createDataFrame([], TABLES[name])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return conform(spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], schema), name)


def entries(spark, *ids, feed=1, **more):
    return spark.createDataFrame([(feed, i, e, more.get("url", f"http://x/{e}"), more.get("title", e), None, 100, more.get("content", "body")) for i, e in enumerate(ids)], ENTRY)


FEEDS = [{"id": 0, "url": CLIPPINGS_URL, "title": "clips", "disabled": True}, {"id": 1, "url": "http://a", "next_fetch": 10}, {"id": 2, "url": "http://b", "next_fetch": 30, "disabled": True, "fail_count": 4}]
ARTICLES = [
    {"id": 1, "feed_id": 1, "entry_id": "a", "title": "SHARED one", "content": "alpha", "starred": True, "published": 5, "fetched_at": 9, "url": "http://x/a"},
    {"id": 2, "feed_id": 1, "entry_id": "b", "title": "SHARED two", "content": "beta", "archived": True, "fetched_at": 7},
    {"id": 3, "feed_id": 1, "entry_id": "c", "title": "plain", "content": "gamma", "read_later": True, "fetched_at": 8},
    {"id": 4, "feed_id": 0, "entry_id": "clip:1", "title": None, "content": "<p>clip delta</p>", "url": "http://c", "fetched_at": 6, "is_read": True, "starred": True},
]
SELECTIONS = [{"id": 1, "article_id": 1, "selected_text": "alpha text", "is_favorite": True, "created_at": 1, "updated_at": 3}, {"id": 2, "article_id": 3, "selected_text": "x", "comment": "my thought", "created_at": 2, "updated_at": 2}, {"id": 3, "article_id": 3, "selected_text": "y", "comment": "  ", "created_at": 2, "updated_at": 2}]


@pytest.fixture(scope="module")
def lib(spark):
    return {n: table(spark, n, r).cache() for n, r in (("feeds", FEEDS), ("articles", ARTICLES), ("article_selections", SELECTIONS))}


def ids(df):
    return [r["id"] for r in df.collect()]


def test_ingest_inserts_once(spark):
    none = table(spark, "articles", [])
    first = feeds.ingest(none, entries(spark, "a", "b"), 50)
    assert feeds.inserted(none, entries(spark, "a", "b")).count() == 2
    assert feeds.inserted(first, entries(spark, "a", "b", "c")).count() == 1
    again = feeds.ingest(first, entries(spark, "a", "b", "c"), 60)
    assert sorted((r["id"], r["entry_id"], r["fetched_at"]) for r in again.collect()) == [(1, "a", 50), (2, "b", 50), (3, "c", 60)]


def test_ingest_keeps_flags_and_content(spark, lib):
    new = spark.createDataFrame([(1, 0, "b", None, "new title", "W", None, ""), (1, 1, "z", None, "first", None, 7, "x"), (1, 2, "z", "http://z", None, None, None, "longer"), (1, 3, "z", None, None, None, None, None)], ENTRY)
    rows = {r["entry_id"]: r for r in feeds.ingest(lib["articles"], new, 99).collect()}
    assert (rows["b"]["title"], rows["b"]["author"], rows["b"]["content"], rows["b"]["archived"], rows["b"]["fetched_at"]) == ("new title", "W", "beta", True, 7)
    assert (rows["z"]["url"], rows["z"]["title"], rows["z"]["published"], rows["z"]["content"], rows["z"]["id"]) == ("http://z", "first", 7, "longer", 5)


def test_normalised_entries(spark):
    schema = "feed_id long, seq long, id string, title string, updated long, published long, content string, summary string, authors array<string>, links array<struct<href:string,rel:string,media_type:string>>, thumbnails array<string>, media array<struct<url:string,type:string>>"
    rows = [(1, 0, None, "T", 7, None, None, "sum", ["A", "B"], [("http://s", "self", None), ("http://l", "alternate", None), ("http://p.png", "enclosure", "image/png")], ["http://t.jpg"], [("http://m", None), ("http://v", "video/mp4"), ("http://t.jpg", "image/jpeg")]), (1, 1, "", None, None, None, None, None, None, None, None, None)]
    a, b = feeds.entry_to_article(spark.createDataFrame(rows, schema)).orderBy("seq").collect()
    assert (a["entry_id"], a["url"], a["author"], a["published"]) == ("http://l", "http://l", "A", 7)
    assert a["content"] == 'sum\n<img src="http://t.jpg">\n<img src="http://m">\n<img src="http://p.png">'
    assert (b["entry_id"], b["content"]) == ("", None)


def test_failures_back_off_and_disable(spark, lib):
    policy = feeds.Policy(disable_after=2)
    bad = spark.createDataFrame([(1, "boom")], "feed_id long, error string")
    once = feeds.record_failure(lib["feeds"], bad, 100, policy)
    twice = feeds.record_failure(once, bad, 200, policy)
    get = lambda df: df.filter("id = 1").first()
    assert (get(once)["fail_count"], get(once)["disabled"], get(once)["next_fetch"]) == (1, False, 220)
    assert (get(twice)["fail_count"], get(twice)["disabled"], get(twice)["last_error"]) == (2, True, "boom")
    good = feeds.record_success(twice, spark.createDataFrame([(1, "Title")], "feed_id long, title string"), 300, policy)
    # a success clears the count but not the mark
    assert (get(good)["fail_count"], get(good)["disabled"], get(good)["title"], get(good)["next_fetch"]) == (0, True, "Title", 1200)


def test_feed_lists_hide_the_clippings(lib):
    assert ids(library.due_feeds(lib["feeds"], 20)) == [1] and ids(library.enabled_feeds(lib["feeds"])) == [1]
    assert [(r["id"], r["unread"]) for r in library.feeds_with_unread(lib["feeds"], lib["articles"]).collect()] == [(1, 2), (2, 0)]
    assert library.earliest_next_fetch(lib["feeds"]).first()["next_fetch"] == 10
    assert [r["status"] for r in library.feed_status(lib["feeds"]).orderBy("id").collect()] == ["ok", "disabled"]
    enabled = library.set_disabled(lib["feeds"], 2, False, 40).filter("id = 2").first()
    assert (enabled["disabled"], enabled["fail_count"], enabled["next_fetch"]) == (False, 0, 40)


def test_views(lib):
    a, f = lib["articles"], lib["feeds"]
    assert ids(library.saved_articles(a, f)) == [4, 1] and ids(library.read_later_articles(a)) == [3]
    assert ids(library.archived_articles(a)) == [2] and ids(library.web_clippings(a, f)) == [4]
    assert ids(library.articles_for_feed(a, 1)) == [3, 1]
    assert library.library_counts(a, f).first().asDict() == {"saved": 2, "read_later": 1, "archived": 1, "clippings": 1, "unread": 2}
    assert ids(library.saved_selections(lib["article_selections"], a)) == [1, 2]
    assert library.selection_counts(lib["article_selections"]).first().asDict() == {"saved": 2, "favorites": 1, "thoughts": 1}


def test_changes(spark, lib):
    a, f = lib["articles"], lib["feeds"]
    some = spark.createDataFrame([(1,), (3,), (3,), (9,)], "id long")
    assert sorted(ids(library.apply_batch(a, some, "archive").filter("archived"))) == [1, 2, 3]
    assert sorted(ids(library.set_flag(a, some, "starred", None).filter("starred"))) == [3, 4]
    assert sorted(ids(library.delete_clipping(a, f, 1))) == [1, 2, 3, 4] and sorted(ids(library.delete_clipping(a, f, 4))) == [1, 2, 3]
    pages = spark.createDataFrame([(" http://n ", " ", "<p>x</p>"), ("u", "t", "  "), (" http://n ", None, "<p>x</p>")], "url string, title string, html string")
    saved = library.save_clippings(a, f, pages, 77).filter("id > 4").collect()
    assert len(saved) == 2 and len({r["entry_id"] for r in saved}) == 2 and all(r["url"] == "http://n" and r["title"] is None and r["is_read"] and r["starred"] for r in saved)
    left = library.remove_feed("http://a", f, a, lib["article_selections"], table(spark, "article_tags", [{"article_id": 1, "tag_id": 1}, {"article_id": 4, "tag_id": 1}]))
    assert [left[k].count() for k in ("feeds", "articles", "article_selections", "article_tags")] == [2, 1, 0, 1]
    assert library.remove_feed("0", f, a, lib["article_selections"], table(spark, "article_tags", []))["feeds"].count() == 3
    added = library.add_feed(f, spark.createDataFrame([("http://a",), ("http://n",), ("http://n",)], "url string"), 5).collect()
    assert sorted((r["id"], r["url"]) for r in added)[-1] == (3, "http://n") and len(added) == 4
    assert library.ensure_clippings_feed(f.filter("id > 0"), 3).filter(F.col("url") == CLIPPINGS_URL).first()["disabled"]


def test_tags(spark):
    tags = table(spark, "tags", [{"id": 1, "name": "Rust"}, {"id": 2, "name": "old"}])
    links = table(spark, "article_tags", [{"article_id": 1, "tag_id": 2}, {"article_id": 2, "tag_id": 1}])
    names = spark.createDataFrame([(1, " 架构 "), (1, "rust"), (1, "RUST"), (1, " ")], "article_id long, name string")
    links, tags = library.replace_tags(links, tags, names, 9)
    assert sorted(r["name"] for r in tags.collect()) == ["Rust", "架构"]
    assert [r["name"] for r in library.tags_for_article(links, tags, 1).collect()] == ["Rust", "架构"]
    draft = spark.range(1).select(library.split_tag_draft(F.lit("a, b，\n c ,")).alias("t")).first()["t"]
    assert draft == ["a", "b", "c"]


def test_selection_checks(spark):
    rows = spark.createDataFrame([("  ", None, None, None, False), ("x", 5, 3, None, False), ("x", 1, 2, "  ", True), (" x ", 1, 2, " c ", True)], "selected_text string, start_offset long, end_offset long, comment string, needs_comment boolean")
    got = library.check_selections(rows).collect()
    assert [r["error"] for r in got] == ["blank text", "bad offsets", "blank comment", None] and (got[3]["selected_text"], got[3]["comment"]) == ("x", "c")


def test_search(spark, lib):
    tags = table(spark, "tags", [{"id": 1, "name": "ai"}])
    rows = search.index_rows(lib["articles"], lib["feeds"], lib["article_selections"], table(spark, "article_tags", [{"article_id": 3, "tag_id": 1}]), tags).cache()
    assert sorted((r["kind"], r["source_id"]) for r in rows.collect()) == [(0, 1), (0, 2), (0, 3), (1, 4), (2, 1), (3, 2)]
    hits = search.search_library(rows, "shared", 20).collect()
    assert [(r["article_id"], r["archived"]) for r in hits] == [(2, True), (1, False)] and len(search.search_library(rows, "SHARED", 1).collect()) == 1
    assert not search.search_library(rows, "  ", 5).collect() and not search.search_library(rows, "x", 0).collect()
    assert [r["article_id"] for r in search.search_library(rows, "AI", 5).collect()] == [3]
    assert {(r["kind"], r["source_id"]) for r in search.search_library(rows, "alp", 5).collect()} == {(0, 1), (2, 1)}
    odd = spark.createDataFrame([(0, 1, "a😀bC"), (0, 2, "ab"), (0, 3, "x\ny😀😀")], "kind int, source_id long, body string")
    assert sorted((r["source_id"], r["trigram"]) for r in search.trigram_postings(odd).collect()) == [(1, "a😀b"), (1, "😀bc"), (3, "\ny😀"), (3, "x\ny"), (3, "y😀😀")]
    found = search.trigram_candidates(search.trigram_postings(rows), "shared")
    assert sorted(r["source_id"] for r in found.collect()) == [1, 2]


def test_history(spark):
    uses = spark.createDataFrame([("Rust", 1, 3), ("rust", 5, 1), (" ", 6, 1)], "query string, used_at long, result_count long")
    (r,) = search.record_history(table(spark, "search_history", []), uses).collect()
    assert tuple(r) == ("Rust", 5, 2, 1)


def test_a_search_leaves_its_trace(spark, lib):
    rows = search.index_rows(lib["articles"], lib["feeds"], lib["article_selections"], table(spark, "article_tags", []), table(spark, "tags", [])).cache()
    history = table(spark, "search_history", [])
    for query, limit, at in (("shared", 1, 10), ("SHARED", 20, 11), ("nowhere", 5, 12), (" ", 5, 13), ("x", 0, 14)):
        _, history = search.search_and_record(rows, history, query, limit, at)
    got = {tuple(r) for r in history.select("query", "last_used_at", "use_count", "result_count").collect()}
    assert got == {("shared", 11, 2, 2), ("nowhere", 12, 1, 0)}


def test_numbers_do_not_depend_on_the_layout(spark):
    rows = spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("wide")).repartition(7)
    got = library.number(rows, ["wide"])
    assert got.agg(F.countDistinct("n"), F.min("n"), F.max("n")).first() == (200_000, 1, 200_000)
    before = got.select("n", F.col("wide").alias("a")).join(got.select((F.col("n") - 1).alias("n"), F.col("wide").alias("b")), "n")
    assert before.filter("a >= b").count() == 0 and before.count() == 199_999


def test_lookups_and_missing_articles(spark, lib):
    assert ids(library.article(lib["articles"], 3)) == [3] and ids(library.article(lib["articles"], 9)) == []
    assert ids(library.feed(lib["feeds"], 1)) == ids(library.feed(lib["feeds"], "http://a")) == [1]
    ai = table(spark, "article_ai", [{"article_id": 1, "summary_zh": "s", "translation_zh": "t"}, {"article_id": 4}])
    assert library.article_ai(ai, 1).first()["summary_zh"] == "s"
    left = library.remove_feed(1, lib["feeds"], lib["articles"], lib["article_selections"], table(spark, "article_tags", []), ai)
    assert [r["article_id"] for r in left["article_ai"].collect()] == [4]
    some = spark.createDataFrame([(1,), (9,)], "id long")
    with pytest.raises(KeyError):
        library.set_flag(lib["articles"], some, "starred", None, strict=True)


def test_match_ranges_and_preview(spark):
    rows = spark.createDataFrame([(1, "ÉA aaa bab"), (2, "none")], "k long, t string")
    got = lambda q: sorted((r["k"], r["start"], r["end"]) for r in search.match_ranges(rows, q, ["k"], "t").collect())
    assert got("aa B") == [(1, 4, 6), (1, 8, 9), (1, 10, 11)] and got(" ") == [] and got("a b") == [(1, 2, 3), (1, 4, 7), (1, 8, 11)]
    text = spark.range(1).select(search.preview(F.lit("one  two three four five six"), "FOUR", 12).alias("p"), search.preview(F.lit(" a  b "), "x").alias("q")).first()
    assert "four" in text["p"] and text["p"].startswith("…") and text["q"] == "a b"


def test_anchors(spark):
    doc = spark.createDataFrame([(1, "new intro. the cat sat. a dog. the cat ran."), (2, "aaaa")], "id long, content string")
    rows = [(1, "the cat", 0, 7, "", " sat"), (1, "the cat", 8, 15, "a dog. ", " ran"), (1, "gone", 0, 4, "", ""), (2, "aa", 9, 11, "", ""), (1, "a dog", 24, 29, "x", "y"), (1, "", 0, 0, "", "")]
    a = spark.createDataFrame(rows, "article_id long, quote string, start_offset long, end_offset long, prefix string, suffix string").withColumn("n", F.monotonically_increasing_id())
    assert [(r["new_start"], r["new_end"]) for r in anchors.resolve(a, doc).orderBy("n").collect()][:5] == [(11, 18), (31, 38), (None, None), (2, 4), (24, 29)]
    one = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(anchors.capture(F.lit("a😀bcdef"), F.lit(1), F.lit(3), 2))), anchors.quote_from_range(F.lit("ab  cd "), F.lit(7), F.lit(2)).alias("q"), anchors.quote_from_range(F.lit("   "), F.lit(0), F.lit(3)).alias("none")).first()
    assert (one["c0"], one["c1"], one["c2"], one["c3"]) == (1, 3, "a", "cd") and tuple(one["q"]) == (4, 6, "cd") and one["none"] is None
    docs = spark.createDataFrame([(1, "x quick brown fox y"), (2, "quick")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "quick brown fox"), (2, "quick"), (3, "ick brown f")], "item_id long, quote string")
    assert sorted(tuple(r) for r in anchors.quote_occurrences(docs, quotes).collect()) == [(1, 1, 1), (2, 1, 1), (2, 2, 1), (3, 1, 1)]
    more = quotes.unionByName(spark.createDataFrame([(4, "fox y"), (5, "brown fox"), (6, ""), (7, "fox y"), (8, None)], quotes.schema))
    want = [(1, 1, 1), (2, 1, 1), (2, 2, 1), (3, 1, 1), (4, 1, 1), (5, 1, 1), (7, 1, 1)]
    # one scan, and one for each portion of a long list
    for most in (1 << 20, 12):
        assert sorted(tuple(r) for r in patterns.counts(docs, more, most).collect()) == want
    over = spark.createDataFrame([(1, "aaaaa"), (2, None), (3, "")], docs.schema)
    assert sorted(tuple(r) for r in anchors.quote_occurrences(over, spark.createDataFrame([(1, "aa"), (2, "a")], quotes.schema)).collect()) == [(1, 1, 2), (2, 1, 5)]
    assert anchors.quote_occurrences(docs, quotes.limit(0)).count() == 0


def test_ranges_cover_original_bytes(spark):
    """Against a search at every place: overlaps, touching ranges, letters of two and four bytes, letters that grow when folded."""
    texts = ["", None, "Thethe HETHE", "ßSSß İi i̇", "🙂the🙂the the", "ÀÉà éa", "th" * 50, "x" * 3000 + "éthe"]
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "k long, t string, start int")
    for query in ("the", "the het", "É à", "i", "🙂 t", "zz"):
        terms = [patterns.folded(t) for t in query.split()]
        want = set()
        for i, t in enumerate(texts):
            low, hit = patterns.folded(t or ""), [False] * (len(t or "") + 1)
            for term in terms:
                at = low.find(term)
                while at >= 0:
                    hit[at : at + len(term)] = [True] * len(term)
                    at = low.find(term, at + len(term))
            joined = set()  # places at which one match ends and another begins are inside a range
            at = 0
            while at < len(hit):
                if hit[at]:
                    z = at
                    while hit[z]:
                        z += 1
                    joined.add((i, len(t[:at].encode()), len(t[:z].encode())))
                    at = z
                at += 1
            want |= joined
        assert {tuple(r) for r in search.match_ranges(rows.drop("start"), query, ["k"], "t").collect()} == want


def test_blob_cache(spark):
    objects = spark.createDataFrame([], "hash string, bytes binary")
    refs = spark.createDataFrame([], "url_hash string, hash string, touched long")
    new = spark.createDataFrame([("u1", b"same"), ("u2", b"same"), ("u3", b"")], "url string, bytes binary")
    o, r = blobcache.put(objects, refs, new, 1)
    assert blobcache.stats(o, r).first().asDict() == {"objects": 1, "bytes": 4, "refs": 2, "used_bytes": 4}
    assert blobcache.get(o, r, spark.createDataFrame([("u2",), ("u9",)], "url string")).first()["bytes"] == b"same"
    o2, r2 = blobcache.put(o, r, spark.createDataFrame([("u4", b"other!")], "url string, bytes binary"), 2)
    o3, r3 = blobcache.prune(o2, r2, 6)
    assert [x["bytes"] for x in o3.collect()] == [b"other!"] and r3.count() == 1
    o4, r4 = blobcache.prune(o2, r2, 0)
    assert o4.count() == 0 and r4.count() == 0
    broken = o2.withColumn("bytes", F.lit(b"x").cast("binary"))
    assert blobcache.heal(broken, r2)[1].count() == 0


def test_vocabulary_and_old_tables(spark):
    rows = spark.createDataFrame([(1, "gui", "active"), (2, "web", "active"), (3, "gui", "lost")], "id long, source string, status string")
    assert sorted((r["id"], r["column"]) for r in violations(rows, "resources").collect()) == [(2, "source"), (3, "status")]
    old = spark.createDataFrame([(1, "x")], "id long, entry_id string")
    assert conform(old, "articles").first()["archived"] is False


def test_fragments_show_where_most_terms_meet(spark):
    """Against every window: most different terms, then most matches, then the first."""
    import random

    rng = random.Random(3)
    texts = [None, "", "no", "alpha"] + ["".join(rng.choice(["alpha", "beta ", "Gamma", "x", " yy ", "é🙂", "filler words "]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    terms = ["alpha", "beta", "gamma"]
    want = {}
    for i, text in enumerate(texts):
        low = patterns.folded(text or "")
        found = sorted((m, m + len(t), t) for t in terms for m in range(len(low)) if low.startswith(t, m))
        windows = []
        for a, _, _ in found:
            inside = [f for f in found if f[0] >= a and f[1] <= a + 34]
            windows.append((-len({t for *_, t in inside}), -len(inside), a, max(z for _, z, _ in inside)))
        if windows:
            *_, a, z = min(windows)
            at = max(0, min(a - (34 - (z - a)) // 2, len(text) - 34))
            want[i] = ("…" if at else "") + text[at : at + 34] + ("…" if at + 34 < len(text) else "")
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r["k"]: r["snippet"] for r in search.snippets(rows, ["k"], "t", "Alpha beta GAMMA alpha").collect()}
    assert {k: v for k, v in got.items() if v is not None} == want and len(got) == len(texts)
    assert search.snippets(rows, ["k"], "t", "x" * 50).filter("snippet is not null").count() == 0


def test_history_is_cleared_whole_or_in_part(spark):
    uses = spark.createDataFrame([("Rust", 1, 2), ("rust", 5, 3), ("spark sql", 2, 1), ("x", 3, 0)], "query string, used_at long, result_count long")
    kept = search.record_history(spark.createDataFrame([], TABLES["search_history"]), uses)
    left = search.clear_history(kept, spark.createDataFrame([(" RUST ",), ("none",), (None,)], "query string"))
    assert sorted(r["query"] for r in left.collect()) == ["spark sql", "x"] and left.columns == kept.columns
    assert search.clear_history(kept).count() == 0
