"""Command line over a library folder: feeds and resources, one JSON envelope per resource command."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern.operators import library as lib
from lectern.operators import resources as res
from lectern.sources.config import seconds
from lectern.sources.payloads import http_get
from lectern.streaming.ingest import update_once
from lectern.tables import Library


def envelope(data=None, error: tuple[str, str] | None = None) -> str:
    if error:
        return json.dumps({"schema_version": 1, "ok": False, "error": {"code": error[0], "message": error[1], "retryable": False}})
    return json.dumps({"schema_version": 1, "ok": True, "data": data, "warnings": []})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern")
    p.add_argument("--root", required=True)
    top = p.add_subparsers(dest="command", required=True)
    top.add_parser("add").add_argument("url")
    top.add_parser("rm").add_argument("target")
    top.add_parser("list")
    top.add_parser("update")
    interval = top.add_parser("set-interval")
    interval.add_argument("id", type=int)
    interval.add_argument("duration", type=seconds)
    for name in ("enable", "disable"):
        top.add_parser(name).add_argument("id", type=int)
    r = top.add_parser("resource").add_subparsers(dest="action", required=True)
    search = r.add_parser("search")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=5)
    search.add_argument("--all-articles", action="store_true")
    search.add_argument("--type", choices=["all", "resource", "article"], default="all")
    for name in ("get", "retry"):
        r.add_parser(name).add_argument("id", type=int)
    r.add_parser("recent").add_argument("--limit", type=int, default=20)
    r.add_parser("pending")
    add = r.add_parser("add")
    add.add_argument("url")
    add.add_argument("--title")
    add.add_argument("--kind", choices=["site", "page", "article"], default="page")
    add.add_argument("--private", action="store_true")
    add.add_argument("--note")
    return p


def main(argv: list[str], spark: SparkSession | None = None, out=sys.stdout, get=http_get) -> int:
    """Exit 0, 3 if a resource is not found, 1 for other failures. get: the client of `update`."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lectern").getOrCreate()
    library = Library(spark, args.root)
    now = int(time.time())
    if args.command == "update":
        print(f"{update_once(library, now, get).first()['articles']} new", file=out)
        return 0
    if args.command != "resource":
        return _feeds(args, library, now, out)
    try:
        code, text = _resource(args, library, now)
    except Exception as e:
        code, text = 1, envelope(error=("FAILED", str(e)))
    print(text, file=out)
    return code


def _feeds(args, library: Library, now: int, out) -> int:
    feeds = library.read("feeds")
    if args.command == "add":
        library.write(feeds=lib.add_feed(feeds, library.spark.createDataFrame([(args.url,)], "url string"), now))
    elif args.command == "rm":
        library.write(**lib.remove_feed(args.target, feeds, *(library.read(t) for t in ("articles", "article_selections", "article_tags", "article_ai"))))
    elif args.command == "set-interval":
        library.write(feeds=lib.set_interval(feeds, args.id, args.duration))
    elif args.command in ("enable", "disable"):
        library.write(feeds=lib.set_disabled(feeds, args.id, args.command == "disable", now))
    else:
        status = lib.feed_status(feeds)
        unread = lib.feeds_with_unread(feeds, library.read("articles")).select("id", "unread")
        for row in status.join(unread, "id").orderBy("id").toLocalIterator():
            print(f"{row['id']}\t{row['title']}\t{row['unread']}\t{row['status']}", file=out)
    return 0


def _resource(args, library: Library, now: int) -> tuple[int, str]:
    spark = library.spark
    resources = library.read("resources")
    table = library.read
    show = lambda rows, field: [json.loads(r["json"]) for r in res.to_json_rows(rows, table("resource_categories"), table("resource_tags"), field).orderBy(F.desc("id")).collect()]
    if args.action == "search":
        # a kind that is not wanted takes no part
        own = resources if args.type != "article" else resources.limit(0)
        read = table("articles") if args.type != "resource" else table("articles").limit(0)
        hits = res.search_json(own, table("resource_snapshots"), table("resource_categories"), table("resource_tags"), read, table("feeds"), args.query, args.limit, args.all_articles)
        return 0, envelope([json.loads(r["json"]) for r in hits.collect()])
    if args.action in ("get", "retry"):
        rows = show(resources.filter(F.col("id") == args.id), "id")
        if not rows:
            return 3, envelope(error=("RESOURCE_NOT_FOUND", f"no resource {args.id}"))
        return 0, envelope(rows[0] if args.action == "get" else {"resource": rows[0], "queued": False, "warning": "no worker takes enrichments from this command"})
    if args.action in ("recent", "pending"):
        rows = res.recent(resources, args.limit) if args.action == "recent" else res.pending(resources)
        return 0, envelope(sorted(show(rows, "recent" if args.action == "recent" else "status"), key=lambda r: (r["updated_at"], int(r["id"])), reverse=True))
    schema = "seq long, url string, kind string, title string, private_note string, privacy string, source string, manual_rating long"
    new = spark.createDataFrame([(0, args.url, args.kind, args.title, args.note, "private" if args.private else "public", "cli_agent", None)], schema)
    after, rejects = res.create(resources, new, now)
    bad = rejects.first()
    if bad is not None:
        return 1, envelope(error=("REJECTED", bad["error"]))
    library.write(resources=after)
    return 0, envelope(show(library.read("resources").orderBy(F.desc("id")).limit(1), "url")[0])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
