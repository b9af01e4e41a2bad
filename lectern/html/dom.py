"""A small HTML tree with the repairs that browsers make: implied ends, void elements, reopened inline formatting."""

from __future__ import annotations

import html as _html
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())
RAW = frozenset(("script", "style"))
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
_HEAD = frozenset("base link meta title style script noscript template".split())


class Node:
    """An element; children are nodes, strings, or comments."""

    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: list[tuple[str, str]] | None = None) -> None:
        self.name, self.parent, self.children = name, None, []
        self.attrs: dict[str, str] = {}
        for k, v in attrs or ():
            self.attrs.setdefault(k, v or "")  # of repeated attributes the first counts

    def append(self, child) -> None:
        if isinstance(child, Node):
            child.parent = self
        elif self.children and type(self.children[-1]) is str and type(child) is str:
            self.children[-1] += child
            return
        self.children.append(child)

    def nodes(self):
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, *names: str) -> list[Node]:
        return [n for n in self.nodes() if n.name in names]

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, Node):
                stack += reversed(c.children)
            elif type(c) is str:
                out.append(c)
        return "".join(out)

    def inner_html(self) -> str:
        out: list[str] = []
        stack: list = [(c, self.name) for c in reversed(self.children)]
        while stack:
            c, parent = stack.pop()
            if isinstance(c, Node):
                out.append("<" + c.name + "".join(f' {k}="{_attribute(v)}"' for k, v in c.attrs.items()) + ">")
                if c.name not in VOID:
                    stack.append((_End(c.name), parent))
                    stack += [(x, c.name) for x in reversed(c.children)]
            elif isinstance(c, _End):
                out.append(f"</{c}>")
            elif isinstance(c, Comment):
                out.append(f"<!--{c}-->")
            else:
                out.append(c if parent in RAW else c.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;"))
        return "".join(out)

    def remove(self, keep) -> None:
        """Drops children, at any depth, for which keep is false."""
        stack = [self]
        while stack:
            node = stack.pop()
            node.children = [c for c in node.children if keep(c)]
            stack += [c for c in node.children if isinstance(c, Node)]


class Comment(str):
    __slots__ = ()


class _End(str):
    __slots__ = ()


def _attribute(value: str) -> str:
    return value.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;")


class _Builder(HTMLParser):
    def __init__(self, root: Node) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[Node] = [root]
        self.active: list[Node] = []  # formatting elements not ended yet

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def _pop_to(self, names: set[str], stop: set[str]) -> None:
        """Ends open elements up to the outermost of names that no element of stop hides."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name in names:
                last = i
                while last > 1 and self.stack[last - 1].name in names:
                    last -= 1
                del self.stack[last:]
                return
            if self.stack[i].name in stop:
                return

    def _reopen(self) -> None:
        open_ = {id(n) for n in self.stack}
        for i, node in enumerate(self.active):
            if id(node) not in open_:
                again = Node(node.name, list(node.attrs.items()))
                self.top.append(again)
                self.stack.append(again)
                self.active[i] = again

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("html", "body") and any(n.name == tag for n in self.stack):
            return
        if tag in _CLOSES:
            self._pop_to(*_CLOSES[tag])
        if tag in BLOCK and any(n.name == "p" for n in self.stack):
            self._pop_to({"p"}, {"table", "td", "th", "button", "caption", "object"})
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.top.name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.stack.pop()
        if tag == "body" and any(n.name == "head" for n in self.stack):
            self._pop_to({"head"}, set())
        if tag == "a" and any(n.name == "a" for n in self.active):
            self.handle_endtag("a")
        if tag not in BLOCK and tag not in _CLOSES and tag not in _HEAD and tag not in ("html", "head", "body"):
            self._reopen()
        node = Node(tag, attrs)
        self.top.append(node)
        if tag not in VOID:
            self.stack.append(node)
            if tag in FORMAT:
                self.active.append(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("math", "svg", "path", "mi", "mo", "mn", "mspace"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag in FORMAT:
            node = next((n for n in reversed(self.active) if n.name == tag), None)
            if node is None:
                return
            self.active.remove(node)
            if node not in self.stack:
                return
            at = self.stack.index(node)
            block = next((i for i in range(at + 1, len(self.stack)) if self.stack[i].name in BLOCK or self.stack[i].name in ("td", "th")), None)
            if block is None:
                del self.stack[at:]
            else:
                # the element ends before the block; the block goes on outside of it
                moved = self.stack[block]
                moved.parent.children.remove(moved)
                node.parent.append(moved)
                del self.stack[at:block]
            return
        if tag == "p" and not any(n.name == "p" for n in self.stack):
            self.top.append(Node("p"))
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == tag:
                del self.stack[i:]
                return
            if tag not in BLOCK and tag not in ("table", "html", "body", "head") and self.stack[i].name in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if data.strip() and self.top.name not in RAW and self.top.name not in ("title", "textarea"):
            self._reopen()
        self.top.append(data)

    def handle_comment(self, data: str) -> None:
        self.top.append(Comment(data))

    def unknown_decl(self, data: str) -> None:
        pass


def parse_fragment(text: str) -> Node:
    """A tree of a piece of HTML; html, head and body tags give way to their contents."""
    root = Node("#fragment")
    builder = _Builder(root)
    builder.feed(text)
    builder.close()
    return root


def parse_document(text: str) -> Node:
    """A tree with html, head and body."""
    root = parse_fragment(text)
    body = next(iter(root.find("body")), None)
    if body is None:
        body, head = Node("body"), Node("head")
        found = next(iter(root.find("html")), root)
        rest = [c for c in found.children if c is not None]
        found.children = []
        seen = False
        for c in rest:
            early = isinstance(c, Node) and (c.name in _HEAD or c.name == "head") and not seen
            blank = isinstance(c, str) and not c.strip()
            if isinstance(c, Node) and c.name == "head":
                head = c
                continue
            seen = seen or not (early or blank)
            (head if early else body).append(c)
        found.append(head)
        found.append(body)
    return root


def clean(text: str) -> str:
    """Lines trimmed, runs of blank lines to one line break, nothing at the ends."""
    out: list[str] = []
    gap = False
    for line in text.replace("\r\n", "\n").split("\n"):
        line = line.strip()
        if line:
            out.append(("\n" if out else "") + ("\n" if gap and out else "") + line)
            gap = False
        else:
            gap = True
    return "".join(out).strip()


def one_line(text: str) -> str:
    return " ".join(text.split())


def decode_entities(text: str) -> str:
    """Decodes the small set of named entities of feeds and all numeric ones, once; others stay as written."""
    import re

    # Named entities that feeds use.
    names = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": " ", "mdash": "—", "hellip": "…"}

    def one(m):
        body = m[1]
        if body in names:
            return names[body]
        number = re.fullmatch(r"#(?:[xX]([0-9a-fA-F]+)|([0-9]+))", body)
        if number:
            value = int(number[1], 16) if number[1] else int(number[2])
            if 0 < value < 0x110000 and not 0xD800 <= value < 0xE000:
                return chr(value)
        return m[0]

    return re.sub(r"&([^;<&\s]{1,10});", one, text)


def unescape(text: str) -> str:
    return _html.unescape(text)
