"""URL filters: parts and rules, the tree against a recursive version in Python, odd addresses."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from lectern.llm import urltree


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def rule(host, path):
    fits = [r for r in urltree.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


def shape(path, depth=8):
    every = [s for s in path.split("/") if s]
    top = ["{long}" if len(s) > 64 else "{x}" if re.fullmatch("[0-9a-fA-F-]{16,}", s) else re.sub("[0-9]+", "{n}", s) for s in every[:depth]]
    return tuple(top + ["**"] * (len(every) > depth))


def brute(urls):
    rows = [(*parts(u), *rule(*parts(u))) for u in urls]
    overall = sum(r[3] == "block" for r in rows) / len(rows)
    pure = lambda own, above: (sum(v == "block" for _, v in own) + 4 * above) / (len(own) + 4)
    scores = {}

    def walk(host, own, level, above, node):
        """own: (shape, verdict) of the addresses at a node of purity `above`."""
        ended = [x for x in own if len(x[0]) == level]
        scores.update({(host, s): (node, above) for s, _ in ended})
        kids = defaultdict(list)
        for x in own:
            if len(x[0]) > level:
                kids[x[0][level]].append(x)
        total = sum(map(len, kids.values()))
        branches = defaultdict(list)
        for seg, found in kids.items():
            branches[seg if len(found) >= 3 and len(found) >= 0.05 * total else "*"] += found
        count = lambda found: (sum(v == "block" for _, v in found), sum(v == "allow" for _, v in found), sum(len(s) == level + 1 for s, _ in found))
        order = sorted(branches, key=lambda k: (k == "*", *(-c / len(branches[k]) for c in count(branches[k])), k.encode()))
        groups = []
        for k in order:
            if groups and k != "*":
                x, y = branches[groups[-1][-1]], branches[k]
                n, m = len(y), len(x)
                if all((b * m - a * n) ** 2 * (n + m) <= 3.84 * n * m * (a + b) * (n + m - a - b) for a, b in zip(count(x), count(y), strict=True)):
                    groups[-1].append(k)
                    continue
            groups.append([k])
        for names in groups:
            found = [x for k in names for x in branches[k]]
            walk(host, found, level + 1, pure(found, above), node + "/" + ("(" + "|".join(sorted(names)) + ")" if len(names) > 1 else names[0]))

    hosts = defaultdict(list)
    for host, path, _, verdict in rows:
        hosts[host].append((shape(path), verdict))
    for host, own in hosts.items():
        walk(host, own, 0, pure(own, overall), "")
    out = []
    for host, path, name, verdict in rows:
        template, score = scores[host, shape(path)]
        out.append((host, path, name, verdict or ("block" if score >= 0.5 else "allow"), template, round(score, 9)))
    return out


def addresses():
    rng = random.Random(6)
    hosts = ["a.example.net", "example.com", "b.example.com", "c.example.org", "example.com:80", "Net", "xnet"]
    tops = ["en", "de", "fr", "es", "news", "item12", "0123456789abcdef01"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(tops)}/{rng.choice(['', 'x/', f'p{rng.randrange(40)}/'])}{rng.randrange(99)}{rng.choice(['', '.html', '?q=1', '#a/b', '/'])}" for _ in range(900)]
    urls += [None, "", "no address", "http://", "http:///de/1", "https://EXAMPLE.com/de/1", "http://net?/x", "http://a.net", "http://net/", "ftp://fr.org/fr/", "http://org/fr", "x://y://z/en", "http://example.com/de", "http://" + "h" * 300 + "/" + "s" * 5000, "http://a.org/" + "a/" * 40, "http://é.example.com/dé/ü?x", "http://a.net//en//1"]
    return urls + urls[:60] + ["http://example.com/de?page"] * 4


def test_judge(spark):
    urls = addresses()
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "score", "n", "shape", "label", "rest", "node")})
    got = {r["page_id"]: (*r[1:-1], round(r["score"], 9)) for r in urltree.judge(df).collect()}
    want = dict(enumerate(brute(urls)))
    assert got == want
    # addresses that no rule fits are judged by what is known of their branch
    assert {v[3] for v in want.values() if v[2] is None} == {"block", "allow"}
    assert any("(" in v[4] for v in want.values())


def test_no_rows_null_ids_and_no_rules(spark):
    schema = "page_id long, url string"
    assert urltree.judge(spark.createDataFrame([], schema)).count() == 0
    got = urltree.judge(spark.createDataFrame([(None, "http://a.net/x"), (None, None)], schema), rules=()).collect()
    assert sorted((r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == [("", "", None, "allow"), ("a.net", "/x", None, "allow")]
