"""Resources, enrichment, storage, streaming, connectors and the command line."""

import io
import json

import pytest
from pyspark.sql import functions as F
from test_library import table

from lectern import cli, tables
from lectern.operators import enrichment, feeds, resources
from lectern.sources import payloads
from lectern.streaming import ingest
from lectern.tables import Library

NEW = "seq long, url string, kind string, title string, private_note string, privacy string, source string, manual_rating long"


def create(spark, stored, *urls, source="gui", rating=None):
    return resources.create(stored, spark.createDataFrame([(i, u, "page", None, None, "public", source, rating) for i, u in enumerate(urls)], NEW), 100)


def test_addresses_are_unique(spark):
    after, rejects = create(spark, table(spark, "resources", []), "https://EXAMPLE.com:443/a#x", "https://example.com/a", "https://example.com/b", "no")
    assert [(r["canonical_url"], r["status"]) for r in after.orderBy("id").collect()] == [("https://example.com/a", "enrichment_pending"), ("https://example.com/b", "enrichment_pending")]
    assert sorted((r["seq"], r["error"]) for r in rejects.collect()) == [(1, "duplicate"), (3, "bad address")]
    again, rejects = create(spark, after, "https://example.com/b", source="cli_agent")
    assert again.count() == 2 and rejects.count() == 1
    assert create(spark, after, "https://n.org", rating=6)[1].first()["error"] == "bad rating"
    assert create(spark, after, "https://n.org", source="cli_agent")[0].filter("id = 3").first()["status"] == "pending_review"


def test_state_machine(spark):
    stored, _ = create(spark, table(spark, "resources", []), "https://a.b", source="cli_agent")
    for to, ok in (("broken", False), ("active", True), ("archived", True), ("active", True), ("broken", True)):
        stored, refused = resources.transition(stored, spark.createDataFrame([(1, to)], "id long, to string"), 5)
        assert (refused.count() == 0) == ok
    one = spark.createDataFrame([(1,)], "id long")
    assert resources.delete(stored, one).count() == 1
    stored, _ = resources.transition(stored, spark.createDataFrame([(1, "archived")], "id long, to string"), 6)
    assert resources.delete(stored, one).count() == 0


def test_tag_provenance(spark):
    up = "seq long, resource_id long, name string, language string, source string, created_at long"
    none = table(spark, "resource_tags", [])
    tags = resources.merge_tags(none, spark.createDataFrame([(0, 1, "rust", "en", "manual", 1), (1, 1, " RUST ", "zh", "ai", 2), (2, 1, "new", "en", "ai", 3), (3, 1, "NEW", "zh", "manual", 4), (4, 1, " ", "en", "ai", 5)], up))
    assert sorted(tuple(r) for r in tags.collect()) == [(1, "new", "zh", "manual", 3), (1, "rust", "en", "manual", 1)]


def test_snapshots(spark):
    schema = "seq long, resource_id long, fetched_url string, http_status long, title string, cleaned_content string, fetched_at long, fetch_error string"
    stored, _ = create(spark, table(spark, "resources", []), "https://a.b")
    rows = [(0, 1, None, 200, "t", "A", 10, None), (1, 1, None, 200, "t", "B", 20, None), (2, 1, None, 200, "t", "A", 30, None), (3, 1, None, 500, None, None, 40, "down")]
    snaps, stored = resources.record_snapshots(table(spark, "resource_snapshots", []), stored, spark.createDataFrame(rows, schema))
    assert [(r["id"], r["cleaned_content"], r["fetch_error"]) for r in snaps.orderBy("id").collect()] == [(1, "A", None), (2, "B", None), (3, None, "down")]
    r = stored.first()
    assert (r["latest_snapshot_id"], r["last_checked_at"]) == (2, 40)
    again, moved = resources.record_snapshots(snaps, stored, spark.createDataFrame([(0, 1, None, 200, "t", "A", 50, None)], schema))
    assert again.count() == 3 and moved.first()["latest_snapshot_id"] == 2 and moved.first()["last_checked_at"] == 50


ANSWER = {"purpose_zh": "Draws icons", "use_when_zh": "for a page", "categories": ["tool"], "tags_en": ["svg", "RUST"]}


@pytest.mark.parametrize(
    ("raw", "error"),
    [
        (json.dumps(ANSWER), None), ("```json\n" + json.dumps(ANSWER | {"evidence": {"no": "list"}}) + "\n```", None), (json.dumps(ANSWER | {"evidence": [{"field": "purpose_zh", "quote": "q"}, {"bad": 1}]}), None), ("not JSON", "not valid JSON"),
        (json.dumps(ANSWER | {"pricing": "trial"}), "invalid pricing"), (json.dumps(ANSWER | {"purpose_zh": "x" * 501}), "invalid purpose_zh"), (json.dumps(ANSWER | {"categories": []}), "invalid categories"), (json.dumps(ANSWER | {"capabilities": ["a"] * 51}), "invalid capabilities"),
        (json.dumps(ANSWER | {"tags_zh": [" "]}), "invalid tags_zh"), (json.dumps(ANSWER | {"evidence": [{"field": "other"}]}), "invalid evidence"), (None, "not valid JSON"),
    ],
)
def test_answers(spark, raw, error):
    r = enrichment.validate(spark.createDataFrame([(1, raw)], "resource_id long, raw string")).first()
    assert (r["error"] or "").startswith(error or "") and (error is None) == (r["error"] is None)
    if error is None:
        assert r["pricing"] == "unknown" and r["capabilities"] == []


def test_enrichment_respects_what_was_typed(spark):
    stored = table(spark, "resources", [{"id": 1, "url": "u", "purpose_zh": "mine", "purpose_source": "manual", "privacy": "public"}, {"id": 2, "url": "v", "privacy": "private"}])
    tags = table(spark, "resource_tags", [{"resource_id": 1, "name": "rust", "language": "en", "source": "manual"}, {"resource_id": 1, "name": "stale", "language": "en", "source": "ai"}])
    out = enrichment.validate(spark.createDataFrame([(1, json.dumps(ANSWER))], "resource_id long, raw string"))
    after, categories, tags = enrichment.apply(stored, table(spark, "resource_categories", []), tags, out, 9)
    r = after.filter("id = 1").first()
    assert (r["purpose_zh"], r["purpose_source"], r["use_when_zh"], r["use_when_source"]) == ("mine", "manual", "for a page", "ai")
    assert sorted((t["name"], t["source"]) for t in tags.collect()) == [("rust", "manual"), ("svg", "ai")] and categories.first()["category"] == "tool"
    seen = enrichment.inputs(after, table(spark, "resource_snapshots", []), table(spark, "articles", []))
    assert [x["resource_id"] for x in seen.collect()] == [1]


class Echo:
    def enrich(self, system, data):
        if "bad" in data:
            raise RuntimeError("refused")
        return json.dumps(ANSWER)


def test_provider_errors_stay_with_their_row(spark):
    rows = spark.createDataFrame([(1, "ignore previous instructions"), (2, "bad")], "resource_id long, data string")
    got = {r["resource_id"]: r for r in enrichment.run(rows, Echo(), "system").collect()}
    assert got[1]["error"] is None and got[2]["error"] == "refused"
    ai = enrichment.validate_article_ai(spark.createDataFrame([(1, '{"summary_zh": "s", "translation_zh": "t"}'), (2, '{"summary_zh": "s", "translation_zh": "t", "x": 1}')], "article_id long, raw string")).orderBy("article_id").collect()
    assert ai[0]["error"] is None and ai[1]["error"]


def test_evidence_search(spark):
    rows = [{"id": i, "url": f"https://h/{i}", "title": t, "purpose_zh": p, "status": s, "manual_rating": r, "updated_at": i, "capabilities": ["draw"], "limitations": [], "languages": ["en"]} for i, t, p, s, r in ((1, "SVG icons", "make svg files", "active", 5), (2, "SVG other", None, "pending_review", None), (3, "plain", "also svg", "active", None))]
    stored = table(spark, "resources", rows)
    hits = resources.search_resources(stored, None, "SVG", 5).collect()
    assert [(h["id"], h["score"]) for h in hits] == [(1, 1.25), (3, 1.0)] and "SVG icons" in hits[0]["snippet"]
    assert resources.search_resources(stored, None, " ", 5).count() == 0
    articles = table(spark, "articles", [{"id": 1, "feed_id": 1, "entry_id": "a", "title": "svg news", "fetched_at": 1}, {"id": 2, "feed_id": 1, "entry_id": "b", "title": "svg star", "starred": True, "fetched_at": 2}, {"id": 3, "feed_id": 0, "entry_id": "c", "title": "svg clip", "fetched_at": 3}])
    f = table(spark, "feeds", [{"id": 0, "url": "local://web-clippings"}, {"id": 1, "url": "http://a"}])
    assert [r["id"] for r in resources.search_articles(articles, f, "svg", 9).collect()] == [3, 2] and resources.search_articles(articles, f, "svg", 9, every=True).count() == 3
    both = resources.search(stored, None, articles, f, "svg", 4)
    assert [(r["result_type"], r["id"]) for r in both.collect()] == [("resource", 1), ("resource", 3), ("article", 3), ("article", 2)]
    shown = json.loads(resources.to_json_rows(stored, table(spark, "resource_categories", [{"resource_id": 1, "category": "tool"}]), table(spark, "resource_tags", [{"resource_id": 1, "name": "x", "language": "en", "source": "ai"}])).filter("id = 1").first()["json"])
    assert shown["id"] == "1" and shown["categories"] == ["tool"] and shown["tags"][0]["source"] == "ai" and shown["pricing"] is None


def test_import_is_idempotent(spark):
    clips = table(spark, "articles", [{"id": 7, "feed_id": 0, "entry_id": "clip:1", "url": "https://h/x#f"}, {"id": 8, "feed_id": 0, "entry_id": "clip:2", "url": None}])
    none = table(spark, "resources", [])
    assert [r["already_imported"] for r in resources.import_preview(clips, none).collect()] == [False]
    once = resources.import_clippings(none, clips, 5)
    twice = resources.import_clippings(once, clips, 6)
    assert once.count() == twice.count() == 1 and once.first()["status"] == "active" and resources.import_preview(clips, once).first()["already_imported"]


RSS = """<rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>R</title><item><guid>g1</guid><title>One</title><link>http://h/1</link>
<pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><description>d</description><content:encoded><![CDATA[<p>c</p>]]></content:encoded><media:thumbnail url="http://h/t.png"/></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><entry><id>e1</id><title>E</title><link rel="self" href="http://h/s"/><link href="http://h/e"/><updated>2024-01-01T00:00:00Z</updated><author><name>Ann</name></author><summary>s</summary></entry></feed>"""
JSON = json.dumps({"version": "https://jsonfeed.org/version/1.1", "title": "J", "items": [{"id": 5, "url": "http://h/j", "content_html": "<p>j</p>", "date_published": "2024-01-01T01:00:00+01:00"}]})


def test_feed_formats(spark):
    rows = spark.createDataFrame([(1, RSS), (2, ATOM), (3, JSON), (4, "<html/>"), (5, None)], "feed_id long, payload string")
    got = {r["feed_id"]: r for r in payloads.parse_feeds(rows).collect()}
    assert [got[i]["feed_title"] for i in (1, 2, 3)] == ["R", "A", "J"] and [got[i]["published"] or got[i]["updated"] for i in (1, 2, 3)] == [1704067200] * 3
    assert got[1]["content"] == "<p>c</p>" and got[1]["thumbnails"] == ["http://h/t.png"] and got[2]["authors"] == ["Ann"] and got[3]["id"] == "5"
    assert got[4]["error"] and got[5]["error"]
    arts = {r["feed_id"]: r for r in feeds.entry_to_article(payloads.parse_feeds(rows).filter("error is null")).collect()}
    assert arts[2]["url"] == "http://h/e" and arts[2]["content"] == "s" and "t.png" in arts[1]["content"]


def test_fetching_is_guarded(spark):
    def get(url):
        if "down" in url:
            raise OSError("no route")
        return (200, b"<!doctype html><p>ok", None) if "ok" in url else (404, b"", "text/html")

    rows = spark.createDataFrame([("https://ok.example/",), ("https://down.example/",), ("http://127.0.0.1/",), ("https://x.example/",)], "url string")
    got = {r["url"]: r for r in payloads.pages(payloads.fetch(rows, get)).collect()}
    assert got["https://ok.example/"]["html"] == "<!doctype html><p>ok" and got["https://down.example/"]["error"] == "no route"
    assert got["http://127.0.0.1/"]["error"] == "address" and got["https://x.example/"]["error"] == "HTTP 404"


def test_versions_backup_and_restore(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    lib.write(feeds=table(spark, "feeds", [{"id": 1, "url": "a"}]), articles=table(spark, "articles", [{"id": 1, "feed_id": 1, "entry_id": "x"}]))
    lib.backup(f"file://{tmp_path}/b1")
    with pytest.raises(FileExistsError):
        lib.backup(f"file://{tmp_path}/b1")
    lib.write(feeds=lib.read("feeds").filter("id < 0"))
    assert lib.broken().first()["problem"] == "feed_id is not in feeds"
    lib.restore(f"file://{tmp_path}/b1", f"file://{tmp_path}/safe")
    assert lib.read("feeds").count() == 1 and lib.broken().count() == 0 and Library(spark, f"file://{tmp_path}/safe").read("feeds").count() == 0
    with pytest.raises(ValueError):
        lib.restore(f"file://{tmp_path}/nothing", f"file://{tmp_path}/safe2")
    before, after = lib.compact()
    assert after < before and lib.read("articles").count() == 1
    names = spark.createDataFrame([(f"b{i}", i) for i in range(12)], "name string, modified long")
    assert tables.keep_latest(names).filter("not keep").count() == 2


def test_streamed_ingest(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    lib.write(feeds=table(spark, "feeds", [{"id": 1, "url": "a"}, {"id": 2, "url": "b"}]))
    schema = "feed_id long, payload string, error string"
    spark.createDataFrame([(1, RSS, None), (2, None, "timeout")], schema).write.parquet(f"{tmp_path}/in/1")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        ingest.start_ingest(stream, lib, f"{tmp_path}/cp", lambda: 1000).awaitTermination()

    run()
    assert lib.read("articles").count() == 1 and {r["id"]: r["fail_count"] for r in lib.read("feeds").collect()} == {1: 0, 2: 1}
    spark.createDataFrame([(1, RSS.replace("g1", "g2"), None), (1, RSS, None)], schema).write.parquet(f"{tmp_path}/in/2")
    run()
    assert sorted(r["entry_id"] for r in lib.read("articles").collect()) == ["g1", "g2"]


def test_streamed_state_equals_batch(spark, tmp_path):
    log = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").cast("long").alias("feed_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    for i in range(3):  # batches in time order
        log.filter(f"seq div 400 = {i}" if i < 2 else "seq >= 800").coalesce(1).write.parquet(f"{tmp_path}/log/{i}")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log/*")
    ingest.failure_state(stream, 3).writeStream.outputMode("update").format("memory").queryName("state").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {r["feed_id"]: (r["fail_count"], r["longest"], r["disabled"]) for r in spark.sql("select * from state").collect()}
    want = {r["feed_id"]: (r["fail_count"], r["longest"], r["disabled"]) for r in feeds.failure_state(log, feeds.Policy(disable_after=3)).collect()}
    assert got == want


def run_cli(spark, root, *args):
    out = io.StringIO()
    code = cli.main(["--root", root, *args], spark, out)
    return code, out.getvalue()


def test_command_line(spark, tmp_path):
    root = f"file://{tmp_path}/lib"
    assert run_cli(spark, root, "add", "http://f")[0] == 0 and "http://f" in run_cli(spark, root, "list")[1]
    code, text = run_cli(spark, root, "resource", "add", "https://h.org/x", "--title", "X")
    data = json.loads(text)
    assert code == 0 and data["data"]["id"] == "1" and data["data"]["status"] == "pending_review" and data["warnings"] == []
    assert len(json.loads(run_cli(spark, root, "resource", "pending")[1])["data"]) == 1
    code, text = run_cli(spark, root, "resource", "get", "999")
    assert code == 3 and json.loads(text)["error"]["code"] == "RESOURCE_NOT_FOUND" and "warnings" not in json.loads(text)
    assert run_cli(spark, root, "resource", "add", "https://h.org/x")[0] == 1
    Library(spark, root).write(resources=Library(spark, root).read("resources").withColumn("status", F.lit("active")))
    (hit,) = json.loads(run_cli(spark, root, "resource", "search", "h.org")[1])["data"]
    assert (hit["id"], hit["matched_fields"], hit["evidence_snippets"][0]["source_type"], hit["score_factors"]) == ("1", ["multi_field"], "multi_field", ["text_match", "no_rating_boost"])
    assert json.loads(run_cli(spark, root, "resource", "search", "h.org", "--type", "article")[1])["data"] == []
    out = io.StringIO()
    assert cli.main(["--root", root, "update"], spark, out, lambda url: (200, ATOM.encode(), None)) == 0 and out.getvalue() == "1 new\n"
    assert run_cli(spark, root, "list")[1].split("\t")[1:] == ["A", "1", "ok\n"]
    assert run_cli(spark, root, "rm", "http://f")[0] == 0 and Library(spark, root).read("articles").count() == 0


def test_rounds_and_waits(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    rows = [{"id": 1, "url": "http://good.example", "next_fetch": 100}, {"id": 2, "url": "http://bad.example", "next_fetch": 150}, {"id": 3, "url": "http://off.example", "disabled": True}]
    lib.write(feeds=table(spark, "feeds", rows))
    get = lambda url: (200, RSS.encode(), None) if "good" in url else (503, b"", None)
    now, slept = [100], []
    waits = ingest.schedule(lib, get, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)), 3)
    # the first is due now, the second in 50 s; a failure waits for two minutes, the next one for four
    assert waits == slept == [50, 120, 240] and lib.read("articles").count() == 1
    assert {r["id"]: (r["fail_count"], r["last_error"]) for r in lib.read("feeds").collect()} == {1: (0, None), 2: (2, "HTTP 503"), 3: (0, None)}
    none = table(spark, "feeds", [{"id": 1, "url": "a", "next_fetch": 10**9}])
    assert [ingest.next_wait(f, 100).first()["wait"] for f in (none, none.limit(0), none.withColumn("next_fetch", F.lit(1)))] == [900, 900, 5]
    assert ingest.update_once(lib, 5000, get).first().asDict() == {"feeds": 0, "articles": 0}


@pytest.mark.parametrize(("name", "text"), [("gbk", "他们在这里说了很多关于工作的事情，也有不少问题"), ("big5", "他們在這裡說了很多關於工作的事情，也有不少問題"), ("cp932", "これは日本語の文章です。よろしくお願いします"), ("cp949", "이것은 한국어로 쓴 문장입니다. 그리고 더 있다"), ("cp1251", "Это предложение написано по-русски"), ("cp1252", "Où est la bibliothèque, déjà fermée à midi ? Größe, señor")])
def test_charsets_without_a_declaration(name, text):
    assert payloads.decode_html(text.encode(name)) == text and payloads.decode_html(text.encode()) == text


def test_redirects_are_checked_hop_by_hop():
    def once(url):
        n = int(url.rsplit("/", 1)[1])
        return (302, b"", None, f"/{n - 1}") if n else (200, b"x", "text/html", None)

    assert payloads.follow("http://a.example/10#x", once, lambda u: None) == (200, b"x", "text/html", "http://a.example/0")
    with pytest.raises(payloads.RedirectError):
        payloads.follow("http://a.example/11", once, lambda u: None)
    with pytest.raises(payloads.RedirectError, match="address"):
        payloads.follow("http://a.example/3", once, lambda u: "address" if u.endswith("/1") else None)
    with pytest.raises(PermissionError):
        payloads.follow("http://a.example/3", once, lambda u: "local")
    answers = {"in.example": ["10.0.0.1"], "mixed.example": ["8.8.8.8", "::1"], "out.example": ["8.8.8.8", "2606:4700::1111"]}

    def lookup(host, _):
        if host not in answers:
            raise OSError("unknown")
        return [(0, 0, 0, "", (ip, 0)) for ip in answers[host]]

    got = [payloads.guarded(f"http://{h}/x", lookup) for h in ("in.example", "mixed.example", "out.example", "no.example", "localhost")]
    assert got == ["address", "address", None, "name: unknown", "local"]


def test_pictures_are_tried_again():
    def answers(*found):
        left = list(found)

        def get(url):
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

        slept = []
        return payloads.picture("http://p", get, slept.append), slept

    assert answers((503, b"", None), OSError("reset"), (200, b"img", None)) == ((b"img", None, 3), [0.5, 1.5])
    assert answers((200, b"", None), (200, b"", None), (200, b"", None)) == ((None, "empty", 3), [0.5, 1.5])
    assert answers((404, b"", None)) == ((None, "HTTP 404", 1), []) and answers(payloads.RedirectError("loop")) == ((None, "loop", 1), [])
    assert answers((200, b"x" * (payloads.MOST_PICTURE + 1), None))[0] == (None, "too large", 1)


def test_a_reader_sees_one_state_or_the_other(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/lib"
    lib, other = Library(spark, root), Library(spark, root)
    lib.write(feeds=table(spark, "feeds", [{"id": 1, "url": "a"}]))

    def cut(*_):
        raise OSError("cut off")

    with monkeypatch.context() as m:
        m.setattr(lib, "_move", cut)
        with pytest.raises(OSError):
            lib.write(feeds=table(spark, "feeds", []))
    assert other.read("feeds").count() == 1
    # of two writers that began with the same state, one fails and changes nothing
    number, pointer = other.state()
    lib.write(feeds=lib.read("feeds").withColumn("title", F.lit("new")))
    with pytest.raises(OSError):
        other._move(number, pointer)
    assert other.read("feeds").first()["title"] == "new"
    with lib.exclusive(), pytest.raises(OSError):
        other.write(feeds=table(spark, "feeds", []))
    for _ in range(12):
        lib._move(*lib.state())
    assert len(lib._numbers()) == tables.POINTERS and lib.read("feeds").count() == 1


def test_maintenance_fences_writers_off(spark, tmp_path):
    """A writer that pauses before it publishes, a compaction in between, a holder that died, and one that wakes up late."""
    root, now = f"file://{tmp_path}/lib", [1000.0]
    lib, other = (Library(spark, root, clock=lambda: now[0]) for _ in range(2))
    lib.write(feeds=table(spark, "feeds", [{"id": 1, "url": "a"}]))
    paused = other.state()
    lib.compact()
    assert not [n for n, s in enumerate(lib.states()) if n == len(lib.states()) - 1 and "_lease" in s]
    with pytest.raises(OSError):  # its state names folders that are gone
        other._move(*paused)
    assert other.read("feeds").count() == 1
    # the holder dies: writers wait until its lease has run out
    held = lib.exclusive(seconds=60)
    held.__enter__()
    with pytest.raises(OSError):
        other.write(feeds=table(spark, "feeds", []))
    now[0] += 61
    other.write(feeds=table(spark, "feeds", [{"id": 2, "url": "b"}]))
    # the late holder can publish nothing any more, and leaving its block changes nothing
    with pytest.raises(OSError):
        lib.write(feeds=table(spark, "feeds", []))
    held.__exit__(None, None, None)
    assert [r["url"] for r in lib.read("feeds").collect()] == ["b"] and "_lease" not in lib.state()[1]
    lib.write(feeds=lib.read("feeds"))


def test_a_state_is_claimed_once(spark, tmp_path):
    """Of many writers that publish after the same state, one wins."""
    from concurrent.futures import ThreadPoolExecutor

    one = tables.Pointers(spark, f"file://{tmp_path}/p")
    assert one.state() == (0, {}) and one.publish(0, {"k": -1}) == 1

    def attempt(k):
        try:
            tables.Pointers(spark, f"file://{tmp_path}/p").publish(1, {"k": k})
            return k
        except tables.Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [k for k in pool.map(attempt, range(16)) if k is not None]
    assert len(won) == 1 and one.state() == (2, {"k": won[0]})


def test_run_log_and_usage(spark):
    none = lambda n: table(spark, n, [])
    new = spark.createDataFrame([(5, 1, "p", "m", "1", "1"), (6, None, "p", "m", "1", "1")], "resource_id long, snapshot_id long, provider string, model string, prompt_version string, schema_version string")
    runs = resources.start_run(none("resource_enrichment_runs"), new, 10)
    done = spark.createDataFrame([(1, "failed", "E", "why")], "id long, status string, error_code string, error_message string")
    got = {r["id"]: (r["resource_id"], r["status"], r["started_at"], r["finished_at"], r["error_code"]) for r in resources.finish_run(resources.start_run(runs, new.limit(1), 20), done, 30).collect()}
    assert got == {1: (5, "failed", 10, 30, "E"), 2: (6, "pending", 10, None, None), 3: (5, "pending", 20, None, None)}
    events = resources.record_usage(none("resource_usage_events"), spark.createDataFrame([(5, "returned", 7), (5, "returned", 7)], "resource_id long, event string, occurred_at long"))
    assert [r["id"] for r in events.orderBy("id").collect()] == [1, 2]


# Invented resources of a small catalogue, and what a reader would ask for with the address that must come up.
CATALOGUE = [
    ("https://paint.example/", "Paintbox", "draw vector pictures in the browser"), ("https://squeeze.example/", "Squeeze", "make picture files smaller"), ("https://palette.example/", "Palette", "choose colours that go together"),
    ("https://glyphs.example/icons?kind=app", "Glyphs", "find app icons as vector files"), ("https://type.example/", "Type Room", "free fonts for web pages"), ("https://charts.example/", "Chart Desk", "draw charts from tables"),
    ("https://sketch.example/", "Sketchpad", "draw system diagrams by hand"), ("https://crates.example/", "Box Index", "find libraries and their manuals"), ("https://gui.example/", "Window Kit", "a toolkit for desktop windows"),
    ("https://photos.example/", "Open Photos", "free photographs"), ("https://sounds.example/", "Open Sounds", "free sound effects"), ("https://regex.example/", "Pattern Lab", "try search patterns"),
]
WANTED = {"vector app icons": 3, "picture smaller": 1, "COLOURS": 2, "free fonts": 4, "system diagrams": 6, "libraries manuals": 7, "desktop windows": 8, "photographs": 9, "charts tables": 5, "Pattern Lab": 11}


def test_accepted_results_come_up(spark):
    rows = [{"id": i, "url": u, "title": t, "purpose_zh": p, "status": "active", "updated_at": i, "capabilities": [], "limitations": [], "languages": []} for i, (u, t, p) in enumerate(CATALOGUE)]
    stored = table(spark, "resources", rows).cache()
    found = [(q, k, r["url"]) for q in WANTED for k, r in enumerate(resources.search_resources(stored, None, q, 5).collect(), 1)]
    accepted = spark.createDataFrame([(q, CATALOGUE[i][0]) for q, i in WANTED.items()], "query string, url string")
    got = resources.acceptance(spark.createDataFrame(found, "query string, rank int, url string"), accepted).collect()
    assert len(got) == 10 and all(r["ok"] for r in got)
    assert not resources.acceptance(spark.createDataFrame(found, "query string, rank int, url string"), accepted.withColumn("url", F.lit("x"))).first()["ok"]


def test_results_as_json(spark):
    stored = table(spark, "resources", [{"id": 4, "url": "https://h/4", "title": "SVG", "private_note": "mine", "status": "active", "manual_rating": 2, "updated_at": 60, "latest_snapshot_id": 9, "capabilities": ["draw"], "limitations": [], "languages": []}])
    articles = table(spark, "articles", [{"id": 7, "feed_id": 1, "entry_id": "a", "title": "svg star", "content": "all of svg", "starred": True, "fetched_at": 2}])
    f = table(spark, "feeds", [{"id": 1, "url": "http://a"}])
    none = lambda n: table(spark, n, [])
    rows = resources.search_json(stored, none("resource_snapshots"), none("resource_categories"), none("resource_tags"), articles, f, "svg", 5).collect()
    a, b = (json.loads(r["json"]) for r in rows)
    assert (a["id"], a["private_note"], a["updated_at"], a["score"], a["score_factors"]) == ("4", {"value": "mine", "source": "local_private_note"}, "1970-01-01T00:01:00Z", 1.1, ["text_match", "manual_rating_boost"])
    assert a["evidence_snippets"] == [{"source_type": "multi_field", "snapshot_id": "9", "article_id": None, "text": "SVG https://h/4 draw"}] and "private_note" in a and a["pricing"] is None
    assert (b["id"], b["result_type"], b["score_factors"], b["matched_fields"], b["tags"], b["evidence_snippets"][0]["text"]) == ("7", "article", ["starred"], ["article_text"], [], "all of svg")


def test_feeds_are_decoded_as_they_declare(spark):
    text = '<rss><channel><title>Größe — 表示</title><item><guid>1</guid></item></channel></rss>'
    declared = lambda name: f'<?xml version="1.0" encoding="{name}"?>{text}'
    cases = [(declared(n).encode(n), None, declared(n)) for n in ("utf-8", "utf-16", "gb18030", "utf-16-le", "utf-32-be")]
    cases += [(text.encode("gb18030"), "text/xml; charset=gb18030", text), (text.encode(), None, text), (b"\xef\xbb\xbf" + text.encode(), "text/xml; charset=gb18030", text), (declared("no-such").encode(), None, declared("no-such")), (b'{"a": "\xc3\xa9"}', "application/json", '{"a": "é"}'), (b"\xff<", None, "\ufffd<"), (b"", None, "")]
    for body, kind, want in cases:
        assert payloads.decode_feed(body, kind).lstrip("\ufeff") == want
    rows = spark.createDataFrame([(i, b, k, None) for i, (b, k, _) in enumerate(cases)] + [(99, None, None, "HTTP 500")], "feed_id long, body binary, content_type string, error string")
    got = {r["feed_id"]: (r["payload"], r["error"]) for r in payloads.decoded_feeds(rows).collect()}
    assert got[99] == (None, "HTTP 500") and all(got[i][0].lstrip("\ufeff") == want for i, (*_, want) in enumerate(cases))
    parsed = payloads.parse_feeds(payloads.decoded_feeds(rows.filter("feed_id < 5"))).collect()
    assert {r["feed_title"] for r in parsed} == {"Größe — 表示"} and all(r["error"] is None for r in parsed)


def test_a_row_is_rejected_once_by_repeated_stored_addresses(spark):
    stored = table(spark, "resources", [{"id": i, "canonical_url": "https://a.b/"} for i in (1, 2, 3)])
    after, rejects = create(spark, stored, "https://a.b", "https://n.org")
    assert [(r["seq"], r["error"]) for r in rejects.collect()] == [(0, "duplicate")] and after.count() == 4


def test_searches_start_from_their_rarest_term(spark, monkeypatch):
    stored = table(spark, "resources", [{"id": i, "url": f"https://a.b/{i}", "title": f"guide {'x' if i % 4 else 'rare'}", "status": "active", "updated_at": i} for i in range(1, 13)])
    seen, real = {}, resources.materialize
    monkeypatch.setattr(resources, "materialize", lambda df, name: seen.setdefault(name, real(df, name)))
    for few in (resources.FEW_QUERIES, 0):
        seen.clear()
        monkeypatch.setattr(resources, "FEW_QUERIES", few)
        queries = spark.createDataFrame([("Guide rare",), ("guide x",), ("guide none",), (" ",)], "query string")
        got = resources.search_many(stored, None, queries, 2).orderBy("query", "rank").collect()
        assert [(r["query"], r["rank"], r["id"]) for r in got] == [("Guide rare", 1, 12), ("Guide rare", 2, 8), ("guide x", 1, 11), ("guide x", 2, 10)]
        assert {r["query"]: r["rarest"] for r in seen["sought"].collect()} == {"Guide rare": "rare", "guide x": "x", "guide none": "none"}
