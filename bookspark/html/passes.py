"""Passes over the sections of one book: which headings aren't sections, and how deep the others lie.

Each pass takes the sections in order and gives them back changed; none looks at more than texts, ranks of tags, levels and
the paragraphs between. A section's parent is the last section before it of a smaller level.
"""

from __future__ import annotations

import re
from dataclasses import replace
from itertools import groupby

from bookspark.html import headings as H

# At least so many entries, of so many words, make a printed table of contents.
PRINTED_ENTRIES, PRINTED_WORDS = 3, 3
# Titles that make a collection; up to so many, one title that holds divisions is enough.
COLLECTION, SMALL_COLLECTION = 3, 10
# Most outliers of a level, and how many times as many sections lie below.
ORPHANS, MAJORITY = 2, 3
# Longest description, least share of capitals in it.
DESCRIPTION, CAPITALS = 300, 0.9
# Places between two headings of one text that part them; words of an epigraph between two; pairs that make a custom.
APART, EPIGRAPH, CUSTOM = 8, 400, 3
# What ends the body of a book.
APPARATUS = re.compile(r"^(?:appendix|notes\s+on\b|(?:a\s+)?review\s*[,;]?\s*(?:and\s+)?conclusion\b|conclusion\s*$)", re.I)
CONCLUSION = re.compile(r"^(?:(?:a\s+)?review\s*[,;]?\s*(?:and\s+)?)?conclusion\s*$", re.I)


def parents(levels: list[int]) -> list[int]:
    """The place of each one's parent, -1 if it has none."""
    out: list[int] = []
    open_: list[int] = []
    for i, n in enumerate(levels):
        while open_ and levels[open_[-1]] >= n:
            open_.pop()
        out.append(open_[-1] if open_ else -1)
        open_.append(i)
    return out


def shifted(sections: list, by: dict[int, int]) -> list:
    """The sections with some levels moved, none above 1."""
    return [replace(s, level=max(1, s.level + by[i])) if i in by else s for i, s in enumerate(sections)]


def without_printed_contents(sections: list) -> list:
    """A row of titles that each end in a page number is a printed table of contents."""

    def printed(s) -> bool:
        m = re.fullmatch(r"(.*\S)\s+\d{1,4}\s*", s.text)
        return bool(m) and not H.keyword(s.text) and len(m[1].split()) >= PRINTED_WORDS

    runs = [(entry, list(run)) for entry, run in groupby(sections, printed)]
    return [s for entry, run in runs if not (entry and len(run) >= PRINTED_ENTRIES) for s in run]


def collection(sections: list) -> list[int]:
    """Places of the works of a collection: titles in large headings, some of which hold parts, books or acts; none if it is one work.

    A title right before a division, after another title without one, is a heading of the book, not a work.
    """
    titles = [i for i, s in enumerate(sections) if s.rank <= 2 and s.level == 2 and H.title_like(s.text) and not H.front_matter(s.text)]
    holding, idle = 0, False
    for i, end in zip(titles, [*titles[1:], len(sections)]):
        broad = [k for k in range(i + 1, end) if H.keyword(sections[k].text) in H.BROAD]
        holding += bool(broad) and not (idle and broad[0] == i + 1)
        idle = not broad
    least = 2 if len(titles) > SMALL_COLLECTION else 1
    return titles if len(titles) >= COLLECTION and holding >= least else []


def unwrapped(sections: list) -> list:
    """What lies under the only title that wraps others is lifted by one: the title is the work's, not a division's.

    Two wrappers are an anthology. Bare numbers under one of several titles are parts of an essay. Numbered titles are sections.
    """
    top = min((s.level for s in sections), default=1)
    up = parents([s.level for s in sections])
    below: dict[int, list[int]] = {}
    for i, p in enumerate(up):
        if p >= 0 and sections[p].level == top and sections[i].level == top + 1:
            below.setdefault(p, []).append(i)
    named = [i for i, s in enumerate(sections) if s.level == top and H.title_like(s.text) and not H.enumerated(s.text)]
    wraps = [i for i in named if i in below]
    if len(wraps) != 1:
        return sections
    peers = any(i not in below and not H.front_matter(sections[i].text) for i in named)
    if peers and all(H.plain_number(sections[i].text) for i in below[wraps[0]]):
        return sections
    end = next((i for i in range(wraps[0] + 1, len(sections)) if sections[i].level <= top), len(sections))
    return shifted(sections, dict.fromkeys(range(wraps[0] + 1, end), -1))


def without_orphans(sections: list) -> list:
    """One or two childless sections above a level that holds nearly all others come down to it."""
    top = min((s.level for s in sections), default=1)
    high = [i for i, s in enumerate(sections) if s.level == top]
    most = sum(s.level == top + 1 for s in sections)
    up = parents([s.level for s in sections])
    held = any(p in high and sections[i].level == top + 1 for i, p in enumerate(up))
    if len(sections) < 3 or len(high) > ORPHANS or most < MAJORITY * len(high) or held or any(H.keyword(sections[i].text) in H.BROAD for i in high):
        return sections
    return shifted(sections, dict.fromkeys(high, 1))


def with_descriptions(d, sections: list) -> tuple[list, set[int]]:
    """(sections, places of paragraphs used up): a paragraph in capitals right under a bare chapter heading is the rest of the heading."""
    out, used = [], set()
    for i, s in enumerate(sections):
        if H.keyword(s.text) and H.keyword(s.text) not in H.BROAD and H.bare(s.text):
            until = sections[i + 1].at if i + 1 < len(sections) else d.high
            b = next(iter(d.between(s.end, until)), None)
            text = b.text() if b is not None and b.tag == "p" else ""
            letters = [c for c in text if c.isalpha()]
            if letters and len(text) <= DESCRIPTION and sum(c.isupper() for c in letters) >= CAPITALS * len(letters):
                s = replace(s, text=f"{s.text} {text}")
                used.add(b.at)
        out.append(s)
    return out, used


def without_repeats(d, sections: list) -> list:
    """Two headings of one text in a row: the second goes if they are close; three and more stay, they are meant.

    Where at least `CUSTOM` such pairs hold a short text between them, it is an epigraph, and the second heading stays alone.
    """
    out: list = []
    runs = [list(run) for _, run in groupby(sections, lambda s: (H.key(s.text), s.level, s.rank))]
    pairs = [r for r in runs if len(r) == 2]
    wide = [r for r in pairs if r[1].at - r[0].at > APART]
    short = {id(r) for r in wide if sum(len(b.text().split()) for b in d.between(r[0].end, r[1].at)) <= EPIGRAPH}
    for r in runs:
        if len(r) != 2 or not H.key(r[0].text):
            out += r
        elif r[1].at - r[0].at <= APART:
            out.append(r[0])
        else:
            out += r[1:] if id(r) in short and len(short) >= CUSTOM else r
    return out


def without_empty_titles(d, sections: list) -> list:
    """A title that has come before and has no text of its own is an ornament."""
    seen: set[str] = set()
    out = []
    for i, s in enumerate(sections):
        known = H.key(s.text) in seen
        seen.add(H.key(s.text))
        if known and H.title_like(s.text) and i + 1 < len(sections) and not d.between(s.end, sections[i + 1].at):
            continue
        out.append(s)
    return out


def before_apparatus(sections: list) -> list:
    """Up to the first heading of an appendix, notes or conclusion, unless a larger heading follows or conclusions are chapters like others."""
    at = next((i for i, s in enumerate(sections) if APPARATUS.match(s.text)), None)
    if at is None:
        return sections
    rank = sections[at].rank
    larger = any(s.rank < rank for s in sections[at + 1 :])
    chapter = at >= 3 and CONCLUSION.match(sections[at].text) and sum(s.rank == rank for s in sections[:at]) >= at // 2
    return sections if larger or chapter else sections[: at + 1]


def dividing(d, rows: list) -> list:
    """The rows (sections by headings alone) that divide the book, without what only looks like a heading.

    Left out are: contents labels and synopses; speakers and stage cues of plays and dialogues; letters and bare numbers in
    rows of small headings; lines of the title page; stubs of front matter and notes of the editor before a real heading.
    """
    empty = [i + 1 < len(rows) and not d.between(rows[i].end, rows[i + 1].at) for i in range(len(rows))]
    play = any(H.keyword(r.text) in ("act", "scene") for r in rows)

    def beside(i: int, test) -> bool:
        """Whether a neighbour without text between passes the test too."""
        return (i > 0 and empty[i - 1] and test(rows[i - 1])) or (empty[i] and test(rows[i + 1]))

    def run(i: int, test) -> int:
        a = b = i
        while a > 0 and test(rows[a - 1]):
            a -= 1
        while b + 1 < len(rows) and test(rows[b + 1]):
            b += 1
        return b - a + 1

    cue = lambda r: r.rank in (5, 6) and H.capitals(r.text, 4) and not H.standing(r.text) and not r.text.upper().startswith("OF ")
    letter = lambda r: r.rank in (4, 5, 6) and bool(re.fullmatch(r"\W*[^\W\d_]\W*", r.text))
    number = lambda r: r.rank in (4, 5, 6) and H.plain_number(r.text)
    out: list = []
    for i, r in enumerate(rows):
        last = out[-1] if out else None
        after = rows[i + 1] if i + 1 < len(rows) else None
        near = [x.text for x in ([rows[i - 1]] if i else []) + ([after] if after else [])]
        titled = last is not None and H.title_like(last.text) and H.title_like(r.text)
        skip = (
            H.ignorable(r.text, r.rank)
            or H.speakers(r.text)
            or (H.capitals(r.text, 3) and any(map(H.speakers, near)))
            or (cue(r) and (play or (last is not None and H.dramatic(last.text)) or beside(i, cue)))
            or (letter(r) and ((last is not None and len(re.findall(r"\b[A-Z]\b", last.text.upper())) >= 3) or beside(i, letter)))
            or (number(r) and last is not None and (beside(i, number) or (not H.keyword(last.text) and run(i, number) >= 3)))
            # the title page: authors and descriptions in small capitals under the title, the title once more but shorter
            or (titled and r.rank > max(3, last.rank) and r.rank < 7 and (r.text.upper().startswith("OF ") or (r.text.isupper() and (len(r.text.split()) >= 5 or r.rank >= 5))))
            or (titled and last is rows[i - 1] and empty[i - 1] and last.text.startswith(f"{r.text} "))
            or (after is not None and after.rank < r.rank and 4 <= r.rank < 7 and empty[i] and H.opening(r.text))
            or (after is not None and empty[i] and bool(H.keyword(after.text)) and H.placeholder(r.text))
        )
        if not skip:
            out.append(r)
    return out
