"""A small document tree of HTML with the repairs that browsers make: missing ends, void tags, raw text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Tags without content, tags that end an open paragraph, and which open tags a tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote center div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl div section body html blockquote".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Node:
    """An element. `at` is its place in document order, `end` the place of its last descendant."""

    __slots__ = ("tag", "attrs", "parent", "children", "at", "end")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, at: int):
        self.tag, self.attrs, self.parent, self.at, self.end = tag, attrs, parent, at, at
        self.children: list[Node | str] = []

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").lower().split()

    def ancestors(self):
        x = self.parent
        while x is not None:
            yield x
            x = x.parent

    def text(self, alt: bool = True, skip_page: bool = True) -> str:
        """The text in one line, without page numbers; breaks are spaces, images their alternative text."""
        out: list[str] = []

        def walk(x: Node) -> None:
            stack: list[Node | str] = [x]
            while stack:
                y = stack.pop()
                if isinstance(y, str):
                    out.append(y)
                elif skip_page and y.tag == "span" and "pagenum" in y.classes() or y.tag in ("script", "style"):
                    continue
                elif y.tag == "br":
                    out.append(" ")
                elif y.tag == "img":
                    label = y.attrs.get("alt", "").strip()
                    if alt and label and not re.fullmatch(r"(?i)(decoration|ornament|illustration|image|cover|\[illustration\]|unavailable)\.?", label):
                        out.append(f" {label} ")
                else:
                    stack.extend(reversed(y.children))

        walk(self)
        return " ".join("".join(out).split())

    def lines(self) -> str:
        """Preformatted text: lines kept, blank ones at either end and spaces at ends of lines left out."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            y = stack.pop()
            if isinstance(y, str):
                out.append(y)
            elif y.tag == "br":
                out.append("\n")
            elif not (y.tag == "span" and "pagenum" in y.classes()):
                stack.extend(reversed(y.children))
        return "\n".join(x.rstrip() for x in "".join(out).split("\n")).strip("\n")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None, 0)
        self.nodes: list[Node] = [self.root]
        self.top = self.root

    def _close(self, node: Node) -> None:
        x = self.top
        while x is not node:
            x.end = len(self.nodes) - 1
            x = x.parent
        node.end = len(self.nodes) - 1
        self.top = node.parent or self.root

    def _open(self, tags: set[str] | frozenset[str], stop: frozenset[str]) -> Node | None:
        x = self.top
        while x is not self.root:
            if x.tag in tags:
                return x
            if x.tag in stop:
                return None
            x = x.parent
        return None

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P and (p := self._open({"p"}, SCOPE | {"td", "th", "li"})):
            self._close(p)
        if tag in ENDS:
            while x := self._open(ENDS[tag], frozenset({"table", "ul", "ol", "dl"})):
                self._close(x)
        if tag in HEADINGS and (h := self._open(set(HEADINGS), SCOPE)):
            self._close(h)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.top, len(self.nodes))
        self.nodes.append(node)
        self.top.children.append(node)
        if tag not in VOID:
            self.top = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.top.tag == tag and tag in ("a", "span", "i", "b"):
            self._close(self.top)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if x := self._open({tag}, frozenset()):
            self._close(x)

    def handle_data(self, data):
        self.top.children.append(data)


def parse(html: str) -> list[Node]:
    """All elements in document order, the root first."""
    b = _Builder()
    b.feed(html)
    b.close()
    b._close(b.root)
    b.root.end = len(b.nodes) - 1
    return b.nodes
