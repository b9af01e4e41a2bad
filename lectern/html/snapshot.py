"""The parts of a page that are kept: title, base, reading scope, without the surroundings."""

from __future__ import annotations

import re
from dataclasses import dataclass

from lectern.functions.urls import resolve
from lectern.html.dom import Comment, Node, one_line, parse_document, parse_fragment

# Elements that belong to the application around an article.
IGNORED = frozenset("head title base meta link script style noscript svg nav header footer aside form iframe".split())


@dataclass
class Snapshot:
    title: str | None
    content: str
    base_href: str | None
    scope: str  # single or index


def is_math_script(node: Node) -> bool:
    return node.name == "script" and node.attrs.get("type", "").strip().lower().startswith("math/tex")


def title_of(document: Node) -> str | None:
    """og:title, else the longest title, else the longest first-level heading."""
    for meta in document.find("meta"):
        kind = meta.attrs.get("property", meta.attrs.get("name", ""))
        if kind.strip().lower() == "og:title" and one_line(meta.attrs.get("content", "")):
            return one_line(meta.attrs["content"])
    for name in ("title", "h1"):
        found = max((one_line(n.text()) for n in document.find(name)), key=len, default="")
        if found:
            return found
    return None


def base_of(document: Node) -> str | None:
    for node in document.find("base"):
        if "href" in node.attrs:
            return node.attrs["href"].strip() or None
    return None


def scope_of(document: Node) -> tuple[Node, str]:
    """The largest main, else body; its one article if there is exactly one."""
    weigh = lambda n: len(n.text().encode()) + len(n.inner_html().encode()) // 8
    broad = max(document.find("main") or document.find("body"), key=weigh, default=document)
    articles = broad.find("article")
    return (articles[0], "single") if len(articles) == 1 else (broad, "index")


def strip_ignored(node: Node) -> Node:
    """Without surroundings and comments; formula scripts stay."""
    node.remove(lambda c: not isinstance(c, Comment) and not (isinstance(c, Node) and c.name in IGNORED and not is_math_script(c)))
    return node


def _drop_repeated_title(node: Node, title: str | None) -> None:
    for i, c in enumerate(node.children):
        if isinstance(c, str) and not c.strip():
            continue
        if isinstance(c, Node) and c.name == "h1" and title is not None and one_line(c.text()) == title:
            del node.children[: i + 1]
        return


def prepare(html: str) -> Snapshot:
    """A page's snapshot. The tree's own scope always counts; no second extractor competes with it."""
    document = parse_document(html)
    title, base = title_of(document), base_of(document)
    node, kind = scope_of(document)
    strip_ignored(node)
    _drop_repeated_title(node, title)
    return Snapshot(title, node.inner_html().strip(), base, kind)


def profile(html: str) -> dict[str, int]:
    """How many of each structure a piece of HTML holds."""
    root = parse_fragment(html)
    count = lambda *names: len(root.find(*names))
    cells = root.find("th", "td")
    return {
        "text_chars": len(re.sub(r"\s+", "", root.text())), "images": count("img"), "figures": count("figure"), "captions": count("figcaption"), "definitions": count("dl", "dt", "dd"), "tables": count("table"), "table_cells": len(cells),
        "spanning_cells": sum("rowspan" in c.attrs or "colspan" in c.attrs for c in cells), "lists": count("ol", "ul", "li"), "links": sum("href" in a.attrs for a in root.find("a")), "code_blocks": count("pre", "code"), "math_nodes": count("math") + sum(is_math_script(s) for s in root.find("script")),
    }


def effective_base(document: Node, page_url: str | None) -> str | None:
    declared = base_of(document)
    return (resolve(declared, page_url) or declared) if declared else page_url


def usable_image(url: str) -> bool:
    return bool(url.strip()) and not re.match(r"(?i)\s*(data:|about:|#)", url)


def srcset_last(value: str) -> str | None:
    found = [c.split()[0] for c in value.split(",") if c.split() and usable_image(c.split()[0])]
    return found[-1] if found else None


def image_url(node: Node) -> str | None:
    """An image's address: lazy-loading attributes before srcset before src."""
    for name in ("data-original", "data-lazy-src", "data-src", "data-url", "data-image"):
        if usable_image(node.attrs.get(name, "")):
            return node.attrs[name].strip()
    for name in ("data-srcset", "srcset"):
        found = srcset_last(node.attrs.get(name, ""))
        if found:
            return found
    src = node.attrs.get("src", "")
    return src.strip() if usable_image(src) else None


def picture_image(picture: Node) -> tuple[str, str | None] | None:
    """The one image of a picture (address, alt): an img with its own srcset, else the last source, else the first img."""
    images = [n for n in picture.find("img") if image_url(n)]
    sources = [n for n in picture.find("source") if image_url(n)]
    alt = next((n.attrs["alt"] for n in images if n.attrs.get("alt")), None)
    own = next((n for n in images if "srcset" in n.attrs or "data-srcset" in n.attrs), None)
    chosen = own or (sources[-1] if sources else images[0] if images else None)
    return (image_url(chosen), alt) if chosen is not None else None
