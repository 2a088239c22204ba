"""HTML books to ordered chunks with up to four divisions.

One function per book, run in Arrow batches. A document is read once into a list of elements; sections come from the
table of contents where it has one, else from headings, else from paragraphs that read like headings; a few passes settle
their levels; then headings and paragraphs are given out in order with the divisions they lie in.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.html import headings as H
from bookspark.html import passes as P
from bookspark.html.dom import HEADINGS, Node, parse
from bookspark.operators.layout import spread

CHUNKER_VERSION = 2
#: Least paragraphs of a text without any section, least letters of text before the first.
FLAT, OPENING = 10, 20
_MARK = re.compile(r"\*{3}\s*(START|END) OF (?:THE|THIS)\b[^*]*EBOOK", re.I)
_NUMBER = re.compile(r"\[?\d+\]?\.?")
SCHEMA = "position int, div1 string, div2 string, div3 string, div4 string, content string, kind string, char_count int"


@dataclass(frozen=True)
class Section:
    """A heading that divides the book. rank: of its tag (1 to 6), 7 for paragraphs; end: place of the heading's last element."""

    at: int
    end: int
    text: str
    level: int
    rank: int


class Document:
    """The elements of one book that matter, in document order, within its bounds."""

    def __init__(self, html: str):
        self.nodes = parse(html)
        self.low, self.high = self._bounds()
        inside = [n for n in self.nodes if self.low < n.at < self.high]
        self.heads = [n for n in inside if n.tag in HEADINGS]
        self.blocks = [n for n in inside if self._is_block(n)]
        self.places = [n.at for n in self.blocks]
        self.anchors: dict[str, Node] = {}
        for n in inside:
            name = n.attrs.get("id") or (n.attrs.get("name") if n.tag == "a" else None)
            if name and (n.tag == "a" or name not in self.anchors):
                self.anchors[name] = n
        self.links = [n for n in inside if n.tag == "a" and "pginternal" in n.classes() and n.attrs.get("href", "").startswith("#")]
        self.tables = {id(b) for b in self.blocks if self.is_toc(b)}

    def _bounds(self) -> tuple[int, int]:
        low, high = 0, len(self.nodes)
        header = next((n for n in self.nodes if n.attrs.get("id") == "pg-header"), None)
        footer = next((n for n in self.nodes if n.attrs.get("id") == "pg-footer"), None)
        start = end = None
        for n in self.nodes:
            for c in n.children:
                if isinstance(c, str) and (m := _MARK.search(c)):
                    if m[1].upper() == "START":
                        start = n
                    elif end is None or end.at < (start.at if start else 0):
                        end = n
        low = header.end if header else start.end if start else low
        if start and start.end > low:
            low = start.end
        high = end.at if end and end.at > low else footer.at if footer and footer.at > low else high
        if footer and low < footer.at < high:
            high = footer.at
        return low, high

    @staticmethod
    def _is_block(n: Node) -> bool:
        if n.tag in ("p", "pre"):
            return not any(a.tag in ("p", "pre") for a in n.ancestors())
        if n.tag == "div":
            inner = any(not isinstance(c, str) and c.tag in ("p", "pre", "div", "table", "ul", "ol", "section", "blockquote", *HEADINGS) for c in n.children)
            return not inner and not any(a.tag in ("p", "pre") for a in n.ancestors()) and bool(n.text())
        return n.tag == "li" and not any(not isinstance(c, str) and c.tag in ("p", "pre", "div", "ul", "ol") for c in n.children) and bool(n.text())

    def is_toc(self, n: Node) -> bool:
        """A paragraph of the table of contents: its class says so, or links leave nothing but punctuation."""
        links = [x for x in self.nodes[n.at + 1 : n.end + 1] if x.tag == "a" and "pginternal" in x.classes()]
        if not links:
            return False
        if any("toc" in c or "contents" in c for c in n.classes()):
            return True
        rest = text = n.text()
        for x in links:
            rest = rest.replace(x.text(), "", 1)
        if not re.search(r"[^\W\d_]{2}", rest):
            return True
        if len(links) > 2 and re.search(r"chapters?:", text, re.I):
            return True  # an index in one line: "Chapter: I., II., III."
        # one link that names a division, its subtitle beside it
        name, beside = H.clean(links[0].text()), rest.strip(" -—:;,.")
        divides = bool(H.keyword(name)) or H.standing(name)
        return len(links) == 1 and divides and text.startswith(links[0].text()) and not H.keyword(beside) and not H.standing(beside)

    def text_of(self, n: Node) -> str:
        return n.lines() if n.tag == "pre" else n.text()

    def heading(self, n: Node) -> str:
        return H.clean(n.text(alt=False) or n.text())

    def between(self, a: int, b: int) -> list[Node]:
        """Blocks after place a and before place b that aren't of the table of contents."""
        return [x for x in self.blocks[bisect_right(self.places, a) : bisect_left(self.places, b)] if id(x) not in self.tables]


def _toc_sections(d: Document) -> list[Section]:
    """Links of the contents, followed to their headings; each heading once."""
    places = [h.at for h in d.heads]
    out: dict[int, Section] = {}
    # links that are page numbers count if at least half of them lie in headings
    paged = [a for x in d.links if re.fullmatch(r"[Pp]age[_-]?\d+", x.attrs["href"][1:]) and _NUMBER.fullmatch(H.clean(x.text())) and (a := d.anchors.get(x.attrs["href"][1:]))]
    by_page = bool(paged) and 2 * sum(any(a.tag in HEADINGS for a in x.ancestors()) for x in paged) >= len(paged)
    for link in d.links:
        if link.parent is not None and any(c.startswith(("footnote", "citation", "fnanchor")) for a in [link, *link.ancestors()] for c in a.classes()):
            continue
        block = next((a for a in link.ancestors() if id(a) in d.tables), None)
        listed = block is not None or any(a.tag in ("tr", "ul", "ol", "nav") or any("toc" in c or "contents" in c for c in a.classes()) for a in link.ancestors())
        entry = H.clean(link.text())
        target = d.anchors.get(link.attrs["href"][1:])
        if target is None or not listed:
            continue
        if _NUMBER.fullmatch(entry):
            if not by_page or not (over := next((a for a in target.ancestors() if a.tag in HEADINGS), None)):
                continue
            entry = d.heading(over)
        if not H.structural(entry):
            continue
        head = target if target.tag in HEADINGS else next((a for a in target.ancestors() if a.tag in HEADINGS), None)
        if head is None:
            i = bisect_left(places, target.at)
            near = d.heads[i : i + 3]
            head = next((h for h in near if H.matches(entry, d.heading(h))), near[0] if near and near[0].at <= target.end + 3 else None)
        strong = any(x.tag in ("b", "strong") for x in [*link.ancestors(), *d.nodes[link.at + 1 : link.end + 1]]) or bool(re.search(r"font-size:\s*(?:1[1-9]\d%|[2-9]\d\d%|1\.[1-9]|[2-9]|large|x-large)", link.attrs.get("style", "")))
        if head is not None:
            text = d.heading(head) or entry
            out.setdefault(head.at, Section(head.at, head.end, text, H.level(text, strong), int(head.tag[1])))
        elif target.at not in out and target.tag in ("p", "div", "a"):
            out[target.at] = Section(target.at, target.at, entry, H.level(entry, strong), 2)
    return P.before_apparatus([out[k] for k in sorted(out)])


def _heading_sections(d: Document) -> list[Section]:
    """Headings that divide, and paragraphs that name acts and scenes of a play."""
    rows = [Section(h.at, h.end, t, H.level(t), int(h.tag[1])) for h in d.heads if H.structural(t := d.heading(h))]
    play = any(H.keyword(r.text) in ("act", "scene") for r in rows) or sum(bool(re.match(r"(?i)(act|scene)\s+[ivxlc\d]+\b", b.text())) for b in d.blocks[:400] if id(b) not in d.tables) > 2
    if play:
        rows += [Section(b.at, b.end, H.clean(t), H.level(t), 7) for b in d.blocks if id(b) not in d.tables and len(t := b.text()) <= 80 and H.keyword(t) in ("act", "scene") and H.bare(re.split(r"[.:—]", t)[0])]
        rows.sort(key=lambda r: r.at)
    return P.dividing(d, P.without_printed_contents(rows))


def _paragraph_sections(d: Document) -> list[Section]:
    """Paragraphs that begin like chapters."""
    out = []
    for b in d.blocks:
        t = b.text()
        if id(b) not in d.tables and H.keyword(t) in ("chapter", "section", "book", "part", "volume", "lecture") and re.match(r"(?i)[a-z]+\.?\s+(?:[ivxlcdm]+|\d+)\b", t):
            short = t if len(t) <= 120 else t[:120].rsplit(" ", 1)[0]
            out.append(Section(b.at, b.end, H.clean(short), H.level(t), 7))
    return out


# A table of contents of at most so many entries is too thin beside more than so many times as many headings.
THIN = ((5, 3), (10, 5), (float("inf"), 10))


def _sparse(toc: list[Section], heads: list[Section]) -> bool:
    return any(len(toc) <= most and len(heads) > times * len(toc) for most, times in THIN)


def _refined(d: Document, toc: list[Section], heads: list[Section]) -> list[Section]:
    """Headings between entries of the contents that stand at least as high as a chapter's, or divide one."""
    have = {s.at for s in toc}
    ranks = Counter(s.rank for s in toc)
    low = max(ranks) if ranks else 6
    subtitles = set()
    for s in toc:
        after = next((h for h in heads if h.at > s.end), None) if H.bare(s.text) else None
        if after and after.at not in have and not d.between(s.end, after.at):
            subtitles.add(after.at)
    extra = [h for h in heads if h.at not in have and h.at > toc[0].at and (H.keyword(h.text) and h.rank <= low + 1 or h.at in subtitles)]
    return sorted([*toc, *extra], key=lambda s: s.at)


# Share of headings in one tag from which the tag says nothing of their depth.
ONE_TAG = 0.8


def _peers(sections: list[Section]) -> set[str]:
    """The one word of broad divisions that stands in the tag that nearly all headings have: it divides nothing from above."""
    ranks = Counter(s.rank for s in sections if s.rank < 7)
    words = {w: Counter(s.rank for s in sections if s.rank < 7 and H.keyword(s.text) == w) for w in map(H.keyword, (s.text for s in sections)) if w in H.BROAD and w not in ("act", "induction", "epilogue")}
    if not ranks or len(words) != 1:
        return set()
    [(rank, n)] = ranks.most_common(1)
    return {w for w, c in words.items() if len(sections) > 2 and n >= ONE_TAG * sum(ranks.values()) and c.most_common(1)[0][0] == rank}


def _nest(sections: list[Section], listed: bool) -> list[Section]:
    """Levels: the works of a collection, in each the broad divisions by their width, others one below the division they lie in, deeper tags deeper.

    `listed`: the sections are those of a table of contents, whose words for divisions mean what they say.
    """
    works = P.collection(sections)
    flat = set() if listed else _peers(sections)
    if not works:
        return _nest_work(sections, flat)
    out = _nest_work(sections[: works[0]], flat)
    for i, end in zip(works, [*works[1:], len(sections)]):
        out += [replace(sections[i], level=1), *[replace(s, level=min(s.level + 1, 4)) for s in _nest_work(sections[i + 1 : end], flat)]]
    return out


def _nest_work(sections: list[Section], flat: set[str]) -> list[Section]:
    out: list[Section] = []
    broad = H.BROAD.keys() - flat
    widths = sorted({H.BROAD[w] for w in map(H.keyword, (s.text for s in sections)) if w in broad})
    stack: list[tuple[int, int, str]] = []  # (level, rank, keyword)
    for s in sections:
        w = H.keyword(s.text)
        if w in broad:
            lev = widths.index(H.BROAD[w]) + 1
            stack = [x for x in stack if x[0] < lev]
        else:
            # a division holds what isn't larger than itself; a heading in a larger tag than the one before isn't under it
            while stack and not (stack[-1][2] in broad and stack[-1][1] <= s.rank or (stack[-1][1] < s.rank and s.rank <= 6)):
                stack.pop()
            if H.front_matter(s.text) and stack and stack[-1][1] >= s.rank:
                stack = []
            lev = stack[-1][0] + 1 if stack else 1
            if w in ("scene", "section") and stack and stack[-1][2] == "chapter":
                lev = stack[-1][0] + 1
        lev = min(lev, 4)
        stack.append((lev, s.rank, w))
        out.append(replace(s, level=lev))
    return out


def _merged(d: Document, sections: list[Section]) -> list[Section]:
    """A bare number, or a bare division that no peers of the next heading follow, and the heading right after it are one."""
    out: list[Section] = []
    for i, s in enumerate(sections):
        last = out[-1] if out else None
        if last is not None and last is sections[i - 1] and H.bare(last.text) and not d.between(last.end, s.at) and not H.bare(s.text) and s.rank >= last.rank and not H.front_matter(s.text) and (tail := H.subtitle(s.text)):
            broad = H.keyword(last.text) in H.BROAD
            peers = i + 1 < len(sections) and sections[i + 1].rank == s.rank and not H.keyword(sections[i + 1].text)
            if not (broad and (peers or H.enumerated(tail) or s.rank == last.rank)):
                out[-1] = replace(last, text=f"{last.text} {s.text}", end=max(s.end, last.end))
                continue
        out.append(s)
    return out


def _without_title_page(d: Document, sections: list[Section]) -> list[Section]:
    """Titles at the very beginning without text of their own, before a heading with a keyword, are no section."""
    i = 0
    while i + 1 < len(sections) and not H.keyword(sections[i].text) and not H.front_matter(sections[i].text) and sections[i].rank <= sections[i + 1].rank and sum(len(d.text_of(b)) for b in d.between(sections[i].end, sections[i + 1].at)) < OPENING:
        i += 1
    return sections[i:] if i and any(H.keyword(s.text) or H.front_matter(s.text) for s in sections[i:]) else sections


def chunk_html(html: str) -> list[tuple[int, str, str, str, str, str, str, int]]:
    """Rows of SCHEMA in order: dense positions from 0, headings and paragraphs with their divisions. No content gives none."""
    d = Document(html or "")
    toc, heads = _toc_sections(d), _heading_sections(d)
    listed = bool(toc) and not _sparse(toc, heads)
    if listed:
        sections = _refined(d, toc, heads)
    else:
        sections = heads
        if len(sections) <= 2 and len(other := _paragraph_sections(d)) > 3 * max(len(sections), 1):
            sections = other
    sections = P.without_printed_contents(sections or _paragraph_sections(d))
    sections = P.without_orphans(P.unwrapped(_nest(_merged(d, _without_title_page(d, sections)), listed)))
    sections, used = P.with_descriptions(d, sections)
    sections = P.without_empty_titles(d, P.without_repeats(d, sections))
    low = min((s.level for s in sections), default=1)
    sections = [replace(s, level=min(s.level - low + 1, 4)) for s in sections]
    out: list[tuple] = []
    divs = [""] * 4

    def give(text: str, kind: str) -> None:
        if text:
            out.append((len(out), *divs, text, kind, len(text)))

    first = sections[0].at if sections else d.high
    before = [x for b in d.between(d.low, first) if (x := d.text_of(b))]
    if sections or len(before) >= FLAT:
        for x in before:
            if len(x) >= OPENING or not sections:
                give(x, "text")
    for i, s in enumerate(sections):
        divs = [*divs[: s.level - 1], s.text, *[""] * (4 - s.level)]
        give(s.text, "heading")
        until = sections[i + 1].at if i + 1 < len(sections) else d.high
        # a heading that divides nothing, as of notes or an index, ends the last section
        if i + 1 == len(sections):
            until = next((h.at for h in d.heads if h.at > s.end and re.match(r"(?i)(?:foot|end)?notes?\b|index\b|transcriber", d.heading(h))), until)
        for b in d.between(s.end, until):
            if b.at not in used:
                give(d.text_of(b), "text")
    return out


def chunk_books(pages: DataFrame, key: str = "book_id", html: str = "html") -> DataFrame:
    """(`key`, SCHEMA, error) of every page. A page that can't be read gives one row with the error and no content; null and empty pages give none."""
    kind = pages.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, page in zip(b["key"], b["page"]):
                try:
                    rows += [(k, *r, None) for r in chunk_html(page)]
                except Exception as x:  # noqa: BLE001
                    rows.append((k, *[None] * len(names), f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(rows, columns=[key, *names, "error"]).astype({"position": "Int32", "char_count": "Int32"})

    source = spread(pages.select(F.col(key).alias("key"), F.col(html).alias("page")).where(F.col(html).isNotNull()))
    return source.mapInPandas(each, f"`{key}` {kind}, {SCHEMA}, error string")
