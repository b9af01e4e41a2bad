"""Connectors: feed payloads (RSS 0.9x/1/2, Atom, JSON Feed) and web pages into rows.

Fetching and parsing are apart: `fetch` fills a payload column, one row per address with its own error, and `parse_feeds`
turns payloads into entries, so everything but the network is tested offline. Clients are injected; `http_get` is the one
that asks the network, with redirects, name answers and sizes checked.
"""

from __future__ import annotations

import codecs
import email.utils
import json
import re
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.urls import check_public_url, is_public_ip, resolve

ENTRY = (
    "feed_id long, feed_title string, seq long, id string, title string, updated long, published long, content string, summary string, authors array<string>, "
    "links array<struct<href:string,rel:string,media_type:string>>, thumbnails array<string>, media array<struct<url:string,type:string>>, error string"
)
_ENTRY_NAMES = [c.split()[0] for c in re.sub(r"<[^>]*>+", "", ENTRY).split(", ")]


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""


def _text(node) -> str | None:
    value = "".join(node.itertext()).strip() if node is not None else ""
    return value or None


def _inner(node) -> str | None:
    """Text of a node; markup of an XHTML body is kept."""
    if node is None:
        return None
    if len(node) == 0:
        return (node.text or "").strip() or None
    for x in node.iter():
        if isinstance(x.tag, str):
            x.tag = x.tag.rsplit("}", 1)[-1]
    return ((node.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in node)).strip() or None


def timestamp(value: str | None) -> int | None:
    """Unix seconds of an RFC 3339 or RFC 2822 date."""
    if not value:
        return None
    value = value.strip()
    try:
        at = datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        try:
            at = email.utils.parsedate_to_datetime(value)
        except (TypeError, ValueError):
            return None
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp())


def parse_feed(payload: str) -> tuple[str | None, list[dict]]:
    """Title and entries of a feed payload; a payload of no known kind is an error."""
    text = payload.lstrip("﻿ \t\r\n")
    if text.startswith("{"):
        return _json_feed(json.loads(text))
    root = ElementTree.fromstring(text)
    kind = _local(root.tag)
    if kind not in ("rss", "rdf", "feed"):
        raise ValueError(f"not a feed: {kind}")
    channel = root if kind == "feed" else next((c for c in root if _local(c.tag) == "channel"), root)
    items = [x for x in ([*root, *channel] if kind == "rdf" else channel) if _local(x.tag) in ("item", "entry")]
    title = _text(next((c for c in channel if _local(c.tag) == "title"), None))
    return title, [_xml_entry(x) for x in items]


def _xml_entry(item) -> dict:
    out: dict = {"id": None, "title": None, "updated": None, "published": None, "content": None, "summary": None, "authors": [], "links": [], "thumbnails": [], "media": []}
    for node in item.iter():
        name, space = _local(node.tag), node.tag.split("}")[0] if isinstance(node.tag, str) and "}" in node.tag else ""
        if "mrss" in space or "search.yahoo.com" in space:
            if name == "thumbnail" and node.get("url"):
                out["thumbnails"].append(node.get("url"))
            elif name == "content" and node.get("url"):
                out["media"].append({"url": node.get("url"), "type": node.get("type")})
    for node in item:
        name, space = _local(node.tag), node.tag.split("}")[0] if "}" in str(node.tag) else ""
        if "search.yahoo.com" in space:
            continue
        if name in ("guid", "id"):
            out["id"] = _text(node)
        elif name == "title" and out["title"] is None:
            out["title"] = _text(node)
        elif name == "link":
            href = node.get("href") or _text(node)
            if href:
                out["links"].append({"href": href, "rel": node.get("rel"), "media_type": node.get("type")})
        elif name == "enclosure" and node.get("url"):
            out["links"].append({"href": node.get("url"), "rel": "enclosure", "media_type": node.get("type")})
        elif name in ("pubdate", "published", "date"):
            out["published"] = out["published"] or timestamp(_text(node))
        elif name in ("updated", "modified"):
            out["updated"] = timestamp(_text(node))
        elif name in ("encoded", "content"):
            out["content"] = _inner(node)
        elif name in ("description", "summary"):
            out["summary"] = _inner(node)
        elif name in ("author", "creator"):
            person = _text(next((c for c in node if _local(c.tag) == "name"), None)) or _text(node)
            if person:
                out["authors"].append(person)
    return out


def _json_feed(feed: dict) -> tuple[str | None, list[dict]]:
    if "jsonfeed.org" not in str(feed.get("version", "")):
        raise ValueError("not a feed: JSON")
    out = []
    for x in feed.get("items", []):
        people = x.get("authors") or ([x["author"]] if x.get("author") else [])
        links = [{"href": x[k], "rel": None, "media_type": None} for k in ("url", "external_url") if x.get(k)]
        links += [{"href": a["url"], "rel": "enclosure", "media_type": a.get("mime_type")} for a in x.get("attachments", []) if a.get("url")]
        out.append({"id": str(x["id"]) if x.get("id") is not None else None, "title": x.get("title"), "updated": timestamp(x.get("date_modified")), "published": timestamp(x.get("date_published")), "content": x.get("content_html") or x.get("content_text"), "summary": x.get("summary"), "authors": [p.get("name") for p in people if p.get("name")], "links": links, "thumbnails": [x["image"]] if x.get("image") else [], "media": []})
    return feed.get("title"), out


def parse_feeds(payloads: DataFrame) -> DataFrame:
    """Entries (columns of ENTRY) of payloads (feed_id, payload, error); a feed that fails is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for feed, payload, error in zip(pdf["feed_id"], pdf["payload"], pdf["error"], strict=True):
                try:
                    if error is not None:
                        raise ValueError(error)
                    title, entries = parse_feed(payload or "")
                    rows += [{"feed_id": feed, "feed_title": title, "seq": i, **e} for i, e in enumerate(entries)] or [{"feed_id": feed, "feed_title": title}]
                except Exception as e:  # one bad feed never fails the round
                    rows.append({"feed_id": feed, "error": str(e) or type(e).__name__})
            out = pd.DataFrame(rows, columns=_ENTRY_NAMES).astype(object)
            yield out.where(out.map(lambda v: isinstance(v, list) or not pd.isna(v)), None)

    rows = payloads if "error" in payloads.columns else payloads.withColumn("error", F.lit(None).cast("string"))
    return rows.select("feed_id", "payload", "error").mapInPandas(run, ENTRY)


def public_answers(host: str, lookup: Callable[..., list] = socket.getaddrinfo) -> str | None:
    """Why a host must not be asked, or None: each of its addresses must be public."""
    try:
        found = {x[4][0] for x in lookup(host, None)}
    except OSError as e:
        return f"name: {e}"
    return None if found and all(is_public_ip(ip.split("%")[0]) for ip in found) else "address"


def guarded(url: str, lookup: Callable[..., list] = socket.getaddrinfo) -> str | None:
    """Why an address must not be fetched, or None: its form first, then where its name leads."""
    return check_public_url(url) or public_answers(urlsplit(url).hostname or "", lookup)


Answer = tuple[int, bytes, str | None, str | None]


def http_once(url: str, timeout: float = 20.0, most: int = 8 << 20) -> Answer:
    """(status, body, content type, where it points) of one request that follows no redirect; at most `most` + 1 bytes."""

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *_):
            return None

    request = urllib.request.Request(url, headers={"User-Agent": "lectern"})
    try:
        with urllib.request.build_opener(Stay).open(request, timeout=timeout) as answer:
            return answer.status, answer.read(most + 1), answer.headers.get("Content-Type"), None
    except urllib.error.HTTPError as e:
        return e.code, b"", e.headers.get("Content-Type"), e.headers.get("Location")


# Redirects that are followed at most, and the status codes that redirect.
MOST_REDIRECTS = 10
REDIRECTS = (301, 302, 303, 307, 308)


class RedirectError(OSError):
    """A redirect that must not or cannot be followed; another attempt would end the same way."""


def follow(url: str, once: Callable[[str], Answer] = http_once, guard: Callable[[str], str | None] = guarded) -> tuple[int, bytes, str | None, str]:
    """(status, body, content type, final address) after at most MOST_REDIRECTS redirects; every hop is checked."""
    for hop in range(MOST_REDIRECTS + 1):
        url = url.split("#", 1)[0]
        why = guard(url)
        if why is not None:
            raise RedirectError(why) if hop else PermissionError(why)
        status, body, kind, target = once(url)
        if status not in REDIRECTS or not target:
            return status, body, kind, url
        url = resolve(target, url) or ""
    raise RedirectError("too many redirects")


def http_get(url: str) -> tuple[int, bytes, str | None]:
    """A client for `fetch`: guarded at every hop, 20 seconds for each request."""
    return follow(url)[:3]


def fetch(rows: DataFrame, get: Callable[[str], tuple[int, bytes, str | None]] = http_get, url: str = "url") -> DataFrame:
    """Adds status, body, content_type, error by an injected client; one request per row, errors as a column.

    The number of partitions bounds how many requests run at once. Addresses that must not be fetched are refused.
    """
    fields = rows.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for address in pdf[url]:
                why = check_public_url(address or "")
                try:
                    status, body, kind = get(address) if why is None else (None, None, None)
                    why = why or (None if 200 <= status < 300 else f"HTTP {status}")
                except Exception as e:
                    status, body, kind, why = None, None, None, str(e) or type(e).__name__
                found.append((status, body, kind, why))
            out = pdf.copy()
            out["status"], out["body"], out["content_type"], out["error"] = zip(*found, strict=True) if found else ([], [], [], [])
            yield out.astype({"status": "Int64"})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", status long, body binary, content_type string, error string"
    return rows.mapInPandas(run, schema)


# Seconds before the second and third attempt at a picture, its most bytes, states worth another attempt.
PAUSES = (0.5, 1.5)
MOST_PICTURE = 25 << 20
TRANSIENT = (408, 425, 429)


def picture(url: str, get: Callable[[str], tuple[int, bytes, str | None]] = http_get, sleep: Callable[[float], None] = time.sleep) -> tuple[bytes | None, str | None, int]:
    """(bytes, error, attempts): failures that may pass (time-outs, connections, empty bodies, 408, 425, 429, 5xx) are
    tried three times; refused addresses, redirects and other states once."""
    why, attempt = None, 0
    for attempt, pause in enumerate((*PAUSES, None), 1):
        try:
            status, body, _ = get(url)
            again = status in TRANSIENT or status >= 500
            why = None if 200 <= status < 300 else f"HTTP {status}"
            if why is None and len(body) > MOST_PICTURE:
                why = "too large"
            elif why is None and not body:
                why, again = "empty", True
            if why is None:
                return body, None, attempt
        except (RedirectError, PermissionError) as e:
            why, again = str(e), False
        except OSError as e:
            why, again = str(e) or type(e).__name__, True
        if not again or pause is None:
            break
        sleep(pause)
    return None, why, attempt


def pictures(rows: DataFrame, get: Callable[[str], tuple[int, bytes, str | None]] = http_get, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, bytes, error, attempts) of pictures; the number of partitions bounds how many are fetched at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for url in pdf["url"]:
                yield pd.DataFrame([(url, *picture(url, get, sleep))], columns=["url", "bytes", "error", "attempts"])

    return rows.select("url").mapInPandas(run, "url string, bytes binary, error string, attempts int")


# Labels that the web platform reads as another encoding.
ALIASES = {"gb2312": "gbk", "gb_2312-80": "gbk", "x-gbk": "gbk", "iso-8859-1": "cp1252", "latin1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "iso8859-1": "cp1252", "l1": "cp1252", "shift_jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "unicode": "utf-16-le", "utf8": "utf-8"}


def _codec(label: str | None) -> str | None:
    name = ALIASES.get((label or "").strip().lower(), (label or "").strip().lower())
    try:
        return codecs.lookup(name).name if name else None
    except LookupError:
        return None


def header_charset(content_type: str | None) -> str | None:
    m = re.search(r"""(?i);\s*charset\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s;]+))""", content_type or "")
    return _codec(next((g for g in m.groups() if g), None)) if m else None


def meta_charset(body: bytes) -> str | None:
    """The encoding that a page declares in its first 4096 bytes."""
    head = body[:4096].decode("latin-1")
    for tag in re.findall(r"(?is)<meta\b[^>]*>", re.sub(r"(?s)<!--.*?-->", "", head)):
        m = re.search(r"""(?is)\bcharset\s*=\s*["']?\s*([^\s"'/>;]+)""", tag)
        if m and _codec(m[1]):
            return _codec(m[1])
    return None


def decode_html(body: bytes, content_type: str | None = None) -> str:
    """Text of a page: byte order mark, then header, then declaration, then a statistical guess."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    name = header_charset(content_type) or meta_charset(body)
    if name:
        return body.decode(name, "replace")
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        pass
    return body.decode(guess_charset(body), "replace")


def xml_charset(body: bytes) -> str | None:
    """The encoding that an XML declaration names, or that its first bytes give away."""
    for start, name in ((b"<\0\0\0", "utf-32-le"), (b"\0\0\0<", "utf-32-be"), (b"<\0", "utf-16-le"), (b"\0<", "utf-16-be")):
        if body.startswith(start):
            return name
    m = re.match(rb"""\s*<\?xml\b[^>]*?\bencoding\s*=\s*["']([A-Za-z0-9._-]+)["']""", body[:512])
    return _codec(m[1].decode()) if m else None


def decode_feed(body: bytes, content_type: str | None = None) -> str:
    """Text of a feed's body: byte order mark, then header, then XML declaration, then UTF-8; bad bytes become U+FFFD."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    return body.decode(header_charset(content_type) or xml_charset(body) or "utf-8", "replace")


def decoded_feeds(fetched: DataFrame) -> DataFrame:
    """Rows of `fetch` (body, content_type) with the column `payload` in place of the body; a null body gives null."""
    rest = [f for f in fetched.schema if f.name != "body"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            payload = [None if body is None else decode_feed(bytes(body), kind) for body, kind in zip(pdf["body"], pdf["content_type"], strict=True)]
            yield pdf.drop(columns="body").assign(payload=pd.Series(payload, dtype=object, index=pdf.index))

    return fetched.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "payload string"]))


# Encodings that pages without a declaration use, and characters that are frequent in their languages.
FREQUENT = {
    "gb18030": "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里",
    "big5": "的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡",
    "cp932": "のにはをたがでとしれさあいうかくけこすそちつてなはまもやよらりるんァアイウカキクコサシスタックトナニハフマムメャュョラリルレロンー日本",
    "cp949": "이다는의에가을를은로한고지하도기사어시리인나자아스대정일서라부해제그보수와들게",
    "cp1251": "оеаинтсрвлкмдпуяыьгзбчйхжшю",
    "cp1252": "éèàçùâêîôûëïäöüßñíóáúãõåæøœ’“”–—…«»€°",
}


def guess_charset(body: bytes) -> str:
    """The encoding whose reading has the largest share of frequent characters beyond ASCII; cp1252 where none has any."""
    best = (0.0, "cp1252")
    for name, frequent in FREQUENT.items():
        try:
            beyond = [c for c in body.decode(name) if c > "\x7f"]
        except UnicodeDecodeError:
            continue
        known = set(frequent)
        best = max(best, (sum(c in known for c in beyond) / max(len(beyond), 1), name), key=lambda x: x[0])
    return best[1]


def pages(fetched: DataFrame, most: int = 8 << 20) -> DataFrame:
    """Decoded pages of fetched rows: `html`, or `error` for a body that is too large or no HTML."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            html, errors = [], []
            for body, kind, error in zip(pdf["body"], pdf["content_type"], pdf["error"], strict=True):
                text, why = None, error
                if why is None and body is None:
                    why = "no body"
                elif why is None and len(body) > most:
                    why = "too large"
                elif why is None:
                    typed = (kind or "").split(";")[0].strip().lower()
                    start = bytes(body[:512]).lstrip(codecs.BOM_UTF8 + b" \t\r\n").lower()
                    sniffed = start.startswith((b"<!doctype html", b"<html", b"<head", b"<body", b"<!--"))
                    if typed not in ("text/html", "application/xhtml+xml") and not (not typed and sniffed):
                        why = "no HTML"
                    else:
                        text = decode_html(bytes(body), kind)
                html.append(text)
                errors.append(why)
            yield pdf.assign(html=html, error=errors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fetched.schema) + ", html string"
    return fetched.mapInPandas(run, schema)
