import pytest

from lectern.html.blocks import content_blocks, plain_text, table_columns
from lectern.html.dom import parse_document, parse_fragment
from lectern.html.snapshot import base_of, prepare, profile, title_of
from lectern.sources.payloads import decode_html, header_charset, meta_charset


def kinds(html, base=None):
    return [(b["kind"], b.get("text")) for b in content_blocks(html, base)]


def test_tree_repairs():
    assert parse_fragment("<p>a<p>b<ul><li>c<li>d</ul>").inner_html() == "<p>a</p><p>b</p><ul><li>c</li><li>d</li></ul>"
    assert parse_fragment("<p><b>a<p>b").inner_html() == "<p><b>a</b></p><p><b>b</b></p>"
    assert parse_fragment("<table><tr><td>1<td>2<tr><td>3</table>").inner_html() == "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>"
    assert parse_fragment("<dl><dt>a<dd>b<dt>c</dl>").inner_html() == "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"
    assert parse_fragment("a &amp;lt; &copy;<br/>").inner_html() == "a &amp;lt; ©<br>"
    assert [n.name for n in parse_document("<title>x</title>y").nodes()] == ["head", "title", "body"]


def test_snapshot():
    page = '<html><head><title>T</title><base href="/b/"></head><body><nav>menu</nav><main><article><h1> T </h1><p>Text<script>x</script></p><!-- c --></article></main></body></html>'
    s = prepare(page)
    assert (s.title, s.base_href, s.scope, s.content) == ("T", "/b/", "single", "<p>Text</p>")
    assert prepare("<body><article>a</article><article>b</article></body>").scope == "index"
    assert title_of(parse_document('<meta property="og:title" content=" O  G "><title>t</title>')) == "O G"
    assert title_of(parse_document("<h1>short</h1><h1>the longer</h1>")) == "the longer"
    assert base_of(parse_document("<p>x")) is None
    assert profile('<ul><li><a href="x">y</a></li></ul><table><tr><td colspan=2>z</td></tr></table>')["spanning_cells"] == 1


def test_paragraphs_and_emphasis():
    assert kinds("<p>one</p><p>two<br>three</p>") == [("Text", "one"), ("Text", "two\nthree")]
    assert kinds("<p>a <strong>b</strong> c</p>") == [("Text", "a"), ("Strong", "b"), ("Text", "c")]
    assert kinds("<h2>Title <b>bold</b></h2>x") == [("Heading", "Title bold"), ("Text", "x")]
    assert kinds("<p>a <code>f()</code> b</p>") == [("Text", "a"), ("InlineCode", "f()"), ("Text", "b")]


def test_headings_with_code_and_links():
    (b,) = content_blocks("<h2>Use <code>é()</code> now</h2>")
    assert b["kind"] == "HeadingWithInlineCode" and b["text"].encode()[b["ranges"][0]["start"] : b["ranges"][0]["end"]].decode() == "é()"
    (b,) = content_blocks('<h3>See <a href="/a">one</a> and <a href="/b">two</a>!</h3>', "https://h.org/")
    assert b["text"] == "See one and two!" and [x["url"] for x in b["links"]] == ["https://h.org/a", "https://h.org/b"]
    assert [b["text"][x["start"] : x["end"]] for x in b["links"]] == ["one", "two"]
    assert kinds('<h2>Name<a href="#name"></a></h2>', "https://h.org/") == [("Heading", "Name")]


def test_links():
    a, b = content_blocks('<p>see <a href="d">docs</a> and</p>', "https://h.org/x/")
    assert (a["kind"], a["text"], a["link_start"], a["url"], a["space_after"]) == ("Link", "see docs", 4, "https://h.org/x/d", True)
    assert b == {"kind": "Text", "text": "and"}
    a, b = content_blocks('<p><a href="/m">modif</a>y</p>', "https://h.org/")
    assert a["space_after"] is False and b["text"] == "y"
    assert kinds('<p>x<a href="#">y</a>z</p>') == [("Text", "xyz")]
    (a,) = content_blocks('<p>t<sup><a href="#fn1">1</a></sup></p>', "https://h.org/p")
    assert a["text"] == "t[1]"


def test_lists():
    got = content_blocks("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>")
    assert [(b["kind"], b.get("depth") or b.get("text")) for b in got] == [("ListItemStart", 1), ("Text", "a"), ("ListItemStart", 2), ("Text", "b"), ("ListItemEnd", 2), ("ListItemEnd", 1), ("ListItemStart", 1), ("Text", "c"), ("ListItemEnd", 1)]


def test_code_quotes_and_math():
    (b,) = content_blocks('<pre class="language-Rust"><code>\nfn x() {\n  1\n}\n</code></pre>')
    assert (b["kind"], b["text"], b["language"]) == ("CodeBlock", "fn x() {\n  1\n}", "rust")
    assert kinds("<pre>a\r\nb</pre>") == [("Code", "a\nb")]
    assert kinds("<blockquote><p>a</p><p>b <i>c</i></p></blockquote>") == [("Quote", "a\nb c")]
    assert kinds("<math display=block><semantics><mi>x</mi><annotation encoding='application/x-tex'>x^2</annotation></semantics></math>") == [("Math", "x^2")]
    (b,) = content_blocks('<script type="math/tex; mode=display">a+b</script>')
    assert (b["kind"], b["text"], b["display"]) == ("Math", "a+b", True)


def test_images():
    page = '<picture><source srcset="/s.webp 1x"><source srcset="/m.webp 1x, /l.webp 2x"><img src="/i.jpg" alt="A"></picture><img src="/l.webp"><a href="/go"><img data-src="/j.png" alt="J"></a><img src="data:x">'
    got = content_blocks(page, "https://h.org/")
    assert [(b["kind"], b.get("uri"), b["url"]) for b in got] == [("Image", None, "https://h.org/l.webp"), ("LinkedImage", "https://h.org/j.png", "https://h.org/go")]
    assert kinds('<picture><source srcset="/s 1x"><img srcset="/big 2x" src="/i"></picture><figcaption>Cap</figcaption>', "https://h.org/")[1] == ("Caption", "Cap")


def test_tables_and_definitions():
    (t,) = content_blocks("<table><tr><th>A<th colspan=2>B</tr><tr><td rowspan=2>1<td>2<td>3</tr><tr><td>4<td>5</tr></table>")
    assert (t["header_rows"], t["column_count"], len(t["rows"])) == (1, 3, 3)
    assert table_columns(t["rows"], 3) == [[(0, 0), (1, 1)], [(0, 0), (1, 1), (2, 2)], [(1, 0), (2, 1)]]
    (d,) = content_blocks("<dl><dt>a<dd>1<dd>2<dt>b</dl>")
    assert d["definitions"] == [{"term": "a", "definitions": ["1", "2"]}]


def test_numbers_and_bullets():
    assert kinds("<p>1.<br>First</p>") == [("Strong", "1. First")]
    assert kinds("<p>Version 1.97.1 is out</p>") == [("Text", "Version 1.97.1 is out")]
    assert kinds("<p>（1）方法</p><p>。更多</p>") == [("Strong", "（1）方法。"), ("Text", "更多")]
    assert kinds("<p>1.</p><p>next</p>") == [("Text", "1. next")]
    assert kinds("<p>intro<br>• a<br>• b</p>") == [("Text", "intro"), ("Text", "• a"), ("Text", "• b")]


def test_base_and_surroundings():
    got = content_blocks('<html><head><base href="/deep/"></head><body><nav>n</nav><header>h</header><p><a href="x">y</a></p><footer>f</footer></body></html>', "https://h.org/a")
    assert [(b["kind"], b["url"]) for b in got] == [("Link", "https://h.org/deep/x")]
    assert content_blocks("") == []


def test_plain_text():
    assert plain_text(content_blocks("<h1>T</h1><p>a <code>b</code>, c</p><p>d</p>")) == "T\n\na b, c\n\nd"


@pytest.mark.parametrize(
    ("body", "header", "text"),
    [("中文".encode("gbk"), "text/html; charset=gb2312", "中文"), (b'<meta charset="gbk">' + "中".encode("gbk"), None, '<meta charset="gbk">中'), (b"\xef\xbb\xbf\xc3\xa9", "text/html; charset=latin1", "é"), ("é".encode(), None, "é"), (b"caf\xe9", "text/html; charset='iso-8859-1'", "café")],
)
def test_charsets(body, header, text):
    assert decode_html(body, header) == text


def test_declared_charsets():
    assert header_charset('text/html; charset="UTF-8"') == "utf-8" and header_charset("text/html") is None
    assert meta_charset(b"<meta http-equiv=content-type content='text/html; charset=shift_jis'>") == "cp932" and meta_charset(b"<p>") is None


def test_page_title_cut_within_a_reference(spark, tmp_path):
    from lectern.plans.pages import page_title
    from lectern.sources.domain import Domain

    spark.createDataFrame([(1, "u", "<title>a &amp; des&amp</title>"), (2, "u", "<title>&lt;b&gt;</title>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r["page_id"]: r["title"] for r in page_title(Domain(spark, str(tmp_path))).collect()} == {1: "a & des&amp", 2: "<b>"}


def test_blocks_leave_in_bounded_batches(spark, monkeypatch):
    """Blocks of many pages, and of one page, leave by BLOCK_ROWS; only named fields are sent."""
    from pyspark.sql import functions as F

    from lectern.html import udfs

    rows = [(1, "<p>a" * 2500, None), (2, None, None), (3, "<p>b<h2>c</h2>", None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string").coalesce(1)
    sizes = []
    real = udfs.lean
    monkeypatch.setattr(udfs, "lean", lambda run: sizes.append(run) or real(run))
    got = udfs.blocks(pages, "page_id", fields=("kind", "text"))
    assert got.columns == ["page_id", "pos", "kind", "text"] and got.groupBy("page_id").agg(F.max("pos")).orderBy("page_id").collect() == [(1, 2499), (3, 1)]
    held = [len(f) for f in sizes[0](iter([pages.withColumnRenamed("page_id", "k").toPandas()]))]
    assert held == [1000, 1000, 502]
    whole = udfs.blocks(pages, "page_id").select("page_id", "pos", "kind", "text")
    assert sorted(map(str, whole.collect())) == sorted(map(str, got.collect()))
