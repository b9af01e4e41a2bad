import ipaddress

import pytest
from pyspark.sql import functions as F

from lectern.functions import scalars, urls
from lectern.html.dom import clean, decode_entities
from lectern.sources.config import Config, load, seconds


def column(spark, make, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "": 1}


def test_durations(spark):
    """A number with or without a unit, at the ends of what is sensible, with and without white space around it."""
    good = {f"{pad}{n}{unit}{pad}": n * size for unit, size in UNITS.items() for n in (0, 1, 59, 100_000) for pad in ("", " ")}
    bad = ["s", "1w", "1.5h", "h1", "1h30", "", "one"]
    assert column(spark, scalars.duration_seconds, [*good, *bad, None]) == [*good.values(), *[None] * len(bad), None]
    plain = {k: v for k, v in good.items() if k.strip() == k}
    assert [seconds(x) for x in plain] == list(plain.values())
    for text in bad:
        with pytest.raises(ValueError):
            seconds(text)


def test_config_is_written_once(tmp_path):
    path = tmp_path / "a/config.toml"
    assert load(path) == Config() and path.exists()
    path.write_text('default_interval_secs = "2h"\nbackoff_cap_secs = 9\n')
    assert load(path) == Config(default_interval_secs=7200, backoff_cap_secs=9)


def test_canonical_addresses(spark):
    given = ["https://EXAMPLE.com:443/a#x", "https://example.com/a", "http://x.org", "HTTP://X.org:8080/a/../b/./c?q=1#f", "ftp://x.org", "no address", " http://x.org:80/ ", "https://u@Host.de/%7Ea", None]
    assert column(spark, urls.canonical, given) == ["https://example.com/a", "https://example.com/a", "http://x.org/", "http://x.org:8080/b/c?q=1", None, None, "http://x.org/", "https://u@host.de/%7Ea", None]


def test_typed_addresses(spark):
    assert column(spark, urls.web_url, ["example.com/x", "http://a.b", "<p>a.b</p>", "two words.", "plain", "ftp://a.b", " a.b "]) == ["https://example.com/x", "http://a.b", None, None, None, None, "https://a.b"]


# Blocks of addresses that are not public.
CLOSED4 = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/3".split()
CLOSED6 = "::/128 ::1/128 ff00::/8 fc00::/7 fe80::/10 2001:db8::/32".split()


def edges(blocks):
    """First and last address of each block, and the neighbours outside that lie in no other block."""
    nets = [ipaddress.ip_network(b) for b in blocks]
    inside = [str(x) for n in nets for x in (n[0], n[-1])]
    top = int(nets[0].max_prefixlen)
    around = [type(nets[0][0])(x) for n in nets for x in (int(n[0]) - 1, int(n[-1]) + 1) if 0 <= x < 1 << top]
    return inside, [str(x) for x in around if not any(x in n for n in nets)]


def test_public_addresses(spark):
    inside, outside = edges(CLOSED4)
    odd = ["8.8.8", "8.8.8.8.8", "8.8.8.256", "8.8.8.-1", "8.8.8.x", ""]
    assert column(spark, urls.is_public_ipv4, [*inside, *odd, *outside]) == [False] * (len(inside) + len(odd)) + [True] * len(outside) and len(outside) > 10
    assert not any(map(urls.is_public_ip, inside)) and all(map(urls.is_public_ip, outside))
    inside6, outside6 = edges(CLOSED6)
    assert not any(map(urls.is_public_ip, inside6)) and all(map(urls.is_public_ip, [x for x in outside6 if not x.startswith("::")]))
    assert [urls.is_public_ip(f"::ffff:{x}") for x in (inside[2], outside[0])] == [False, True]


def spellings(ip):
    """Ways to write an address as a host: dotted, one number, hexadecimal, octal parts, fewer parts."""
    parts = [int(x) for x in ip.split(".")]
    whole = int(ipaddress.ip_address(ip))
    return [ip, str(whole), hex(whole), ".".join(hex(x) for x in parts), ".".join(f"0{x:o}" for x in parts), f"{parts[0]}.{whole & 0xFFFFFF}", f"{parts[0]}.{parts[1]}.{whole & 0xFFFF}", f"[::ffff:{ip}]", ip + "."]


def test_addresses_not_to_fetch():
    hosts = [h for ip in ("127.0.0.1", "10.1.2.3", "192.168.7.9") for h in spellings(ip)] + ["[::1]", "localhost", "localhost.", "deep.localhost", ""]
    assert [h for h in hosts if urls.check_public_url(f"http://{h}/x") is None] == []
    assert [x for x in ("gopher://a.b", "a.b", "https://me@a.b", "https://me:pw@a.b") if urls.check_public_url(x) is None] == []
    assert [h for h in spellings("9.9.9.9") if urls.check_public_url(f"http://{h}/x") is not None] == []


def test_addresses_to_fetch():
    assert urls.check_public_url("https://example.com/x?y#z") is None and urls.check_public_url("http://8.8.8.8:80/") is None


def test_resolution():
    base = "https://h.org/a/b/c?q#f"
    cases = {"x": "https://h.org/a/b/x", "../x": "https://h.org/a/x", "/x/./y": "https://h.org/x/y", "//o.org/z": "https://o.org/z", "#s": "https://h.org/a/b/c?q#s", "?k": "https://h.org/a/b/c?k", "http://o.org": "http://o.org"}
    assert {k: urls.resolve(k, base) for k in cases} == cases
    assert urls.resolve("x", None) is None
    assert [urls.link_target(h, base) for h in ("", "#", "javascript:x()", "data:x", "mailto:a@b", "x")] == [None, None, None, None, "mailto:a@b", "https://h.org/a/b/x"]


def test_small_functions(spark):
    assert column(spark, scalars.format_bytes, [0, 1023, 1024, 1536, 5 << 20, 3 << 30, 2 << 40], "long") == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "3.0 GB", "2.0 TB"]
    assert column(spark, scalars.is_retryable, [429, 408, 425, 502, 404, 403], "long") == [True, True, True, True, False, False]
    assert column(spark, scalars.number_marker, ["1. A", "1.97.1", "（3）x", "(4) y", "12、z", "3.", "x 1."]) == ["1.", None, "（3）", "(4)", "12、", "3.", None]
    assert column(spark, scalars.last_srcset, ["a.jpg 1x, b.jpg 2x", "data:x 1x", "a.jpg 1x, about:blank 2x"]) == ["b.jpg", None, "a.jpg"]
    assert column(spark, scalars.extract_json_object, ['x {"a": {"b": 1}} y', "none"]) == ['{"a": {"b": 1}}', None]
    assert column(spark, scalars.looks_like_html, ["  <!DOCTYPE html>", "﻿<html>", "text", "<!-- x", None]) == [True, True, False, True, False]
    assert column(spark, scalars.is_html_type, ["Text/HTML; x", "text/plain", None]) == [True, False, False]
    assert column(spark, scalars.rfc3339, [0, 1704067200], "long") == ["1970-01-01T00:00:00Z", "2024-01-01T00:00:00Z"]
    assert column(spark, lambda v: scalars.with_base(F.lit("<p>"), v), ['a"b', None]) == ['<base href="a&quot;b"><p>', "<p>"]


def test_entities_and_text():
    assert decode_entities("&amp;lt; &copy; &#233;&#x4e2d; &hellip; &toolongentityname; &") == "&lt; &copy; é中 … &toolongentityname; &"
    assert clean("  a  \n\n\n b\nc  \n") == "a\n\nb\nc"


def test_separators(spark):
    """Each rule by one pair of blocks."""
    off = dict.fromkeys(("strong", "link", "next_strong", "next_link", "next_prefixed", "code", "next_code"), False)
    cases = [
        ("（1）", "label", {"next_strong": True}, " "), ("one", "two", {}, "\n\n"), ("one", "two", {"next_link": True}, "\n\n"), ("one", "two", {"next_link": True, "next_prefixed": True}, " "), ("note", "2. two", {"link": True}, "\n\n"),
        ("modif", "y", {"link": True}, ""), ("字", "文", {"link": True}, ""), ("字", "a", {"link": True}, " "), ("one", ", two", {"link": True}, ""), ("one.", "字", {"link": True}, "\n\n"), ("字", "文", {"strong": True, "next_strong": True}, "\n\n"),
        ("one —", "字", {"next_link": True, "next_prefixed": True}, " "), ("", "two", {"strong": True}, ""), ("run", "ls", {"next_code": True}, " "), ("ls", ".", {"code": True}, ""), ("(", "ls", {"next_code": True}, ""), ("字", "ls", {"next_code": True}, " "),
    ]
    rows = spark.createDataFrame([(i, a, b, *(off | flags).values()) for i, (a, b, flags, _) in enumerate(cases)], "i int, a string, b string, " + ", ".join(f"{k} boolean" for k in off))
    got = rows.select("i", scalars.fragment_separator(F.col("a"), F.col("b"), **{k: F.col(k) for k in off}).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [want for *_, want in cases]


def test_seams_by_their_tables(spark):
    """Every pair of classes with every relation, against the table read by hand: the first row that fits."""
    left = {"void": " ", "open": "x (", "dash": "x –", "stop": "x。", "latin": "xa ", "under": "x_", "wide": "x文", "other": "x+"}
    right = {"void": "\n", "close": "，x", "latin": " ax", "under": "_x", "wide": "文x", "other": "+x"}
    relations = [{"link": True}, {"strong": True}, {"strong": True, "next_strong": True}, {"next_link": True, "next_prefixed": True}, {"code": True}, {"next_code": True}, {"link": True, "strong": True, "next_strong": True}]
    off = dict.fromkeys(("strong", "link", "next_strong", "next_link", "next_prefixed", "code", "next_code"), False)
    named = {"linked": ["link"], "bold": ["strong", "next_strong"], "leading": ["next_link"], "code": ["code"], "tocode": ["next_code"], "*": []}
    rows, want = [], []
    for a, before in left.items():
        for z, after in right.items():
            for flags in relations:
                table = scalars.CODE_SEAMS if {"code", "next_code"} & set(flags) else scalars.SEAMS
                cells = [line.split() for line in table.strip().split("\n")]
                fits = [what for x, y, how, what in cells if (x == "*" or a in x.split(",")) and (y == "*" or z in y.split(",")) and all(flags.get(f) for f in named[how])]
                want.append(scalars.BETWEEN[fits[0] if fits else "-"])
                rows.append((len(rows), before, after, *(off | flags).values()))
    df = spark.createDataFrame(rows, "i int, a string, b string, " + ", ".join(f"{k} boolean" for k in off))
    got = df.select("i", scalars.fragment_separator(F.col("a"), F.col("b"), **{k: F.col(k) for k in off}).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == want


def test_sizes_up_to_a_largest_unit(spark):
    sizes = [1 << 30, 1 << 40, 3 << 41]
    assert column(spark, lambda c: scalars.format_bytes(c, "GB"), sizes, "long") == ["1.0 GB", "1024.0 GB", "6144.0 GB"]


def test_plain_references(spark):
    assert column(spark, scalars.plain_references, ["a &amp; b&amp", "&lt;&copy;&#65; &ampx"]) == ["a &amp; b&amp;amp", "&lt;&amp;copy;&amp;#65; &amp;ampx"]
