"""Small pages of our own, one for each rule of the chunker, with the headings it must give and the divisions these lie in.

The expected rows are written by hand from the rules, not taken from a run.
"""

from __future__ import annotations

_TEXT = "The keepers went down to the harbour before the light was gone."


def _page(*parts: str) -> str:
    """Headings as "2 Title"; a dot stands for a paragraph; what begins with a bracket is HTML as it is."""
    out = []
    for p in parts:
        if p == ".":
            out.append(f"<p>{_TEXT}</p>")
        elif p.startswith("<"):
            out.append(p)
        else:
            out.append(f"<h{p[0]}>{p[2:]}</h{p[0]}>")
    return f"<html><body>{''.join(out)}</body></html>"


def _contents(*entries: tuple[str, str], tag: str = "p") -> str:
    return "".join(f'<{tag} class="toc"><a href="#{i}" class="pginternal">{t}</a></{tag}>' for i, t in entries)


#: name: (page, headings as divisions from the widest, " / " between)
PAGES: dict[str, tuple[str, list[str]]] = {
    "nesting": (_page("2 PART I", ".", "2 BOOK I", ".", "2 Chapter 1", ".", "2 PART II", ".", "2 Chapter 2", "."), ["PART I", "PART I / BOOK I", "PART I / BOOK I / Chapter 1", "PART II", "PART II / Chapter 2"]),
    "printed contents": (_page("2 The Will to Weave 1", "2 The Sense of Salt 63", "2 The Old Bridge Road 111", "2 The Will to Weave", ".", "2 The Sense of Salt", "."), ["The Will to Weave", "The Sense of Salt"]),
    "two numbered titles are no contents": (_page("2 The Will to Weave 1", ".", "2 The Sense of Salt 63", "."), ["The Will to Weave 1", "The Sense of Salt 63"]),
    "collection": (
        _page("2 The Salt King", ".", "3 ACT I", ".", "4 SCENE I", ".", "3 ACT II", ".", "2 The Bell", ".", "3 ACT I", ".", "2 The Weaver", ".", "3 ACT I", "."),
        ["The Salt King", "The Salt King / ACT I", "The Salt King / ACT I / SCENE I", "The Salt King / ACT II", "The Bell", "The Bell / ACT I", "The Weaver", "The Weaver / ACT I"],
    ),
    "one rank for all": (_page("4 BOOK I", ".", "4 The Salt Road", ".", "4 The Mill Race", ".", "4 BOOK II", "."), ["BOOK I", "The Salt Road", "The Mill Race", "BOOK II"]),
    "larger headings after smaller": (_page("3 The Opening", ".", "4 Its Second Half", ".", "2 The Harbour", ".", "3 The Quay", "."), ["The Opening", "The Opening / Its Second Half", "The Harbour", "The Harbour / The Quay"]),
    "title over chapters": (_page("1 The Miller", ".", "2 CHAPTER I", ".", "2 CHAPTER II", "."), ["The Miller", "CHAPTER I", "CHAPTER II"]),
    "anthology": (_page("1 The Miller", ".", "2 CHAPTER I", ".", "1 The Weaver", ".", "2 CHAPTER I", "."), ["The Miller", "The Miller / CHAPTER I", "The Weaver", "The Weaver / CHAPTER I"]),
    "essays with numbered parts": (_page("1 On Mills", ".", "2 I", ".", "2 II", ".", "1 On Salt", "."), ["On Mills", "On Mills / I", "On Mills / II", "On Salt"]),
    "subtitle in a heading": (_page("2 CHAPTER I", "3 The Ferry", ".", "2 CHAPTER II", "3 The Toll", "."), ["CHAPTER I The Ferry", "CHAPTER II The Toll"]),
    "description in capitals": (_page("2 CHAPTER I", "<p>TREATING OF SHOES AND OF THE SEA</p>", ".", "2 CHAPTER II", "."), ["CHAPTER I TREATING OF SHOES AND OF THE SEA", "CHAPTER II"]),
    "a pair collapses": (_page("2 The Ferry", "2 The Ferry", ".", "2 The Toll", "."), ["The Ferry", "The Toll"]),
    "three stay": (_page("2 Tales of the Inn", ".", "2 Tales of the Inn", ".", "2 Tales of the Inn", "."), ["Tales of the Inn", "Tales of the Inn", "Tales of the Inn"]),
    "letters of one date": (_page("2 July 28th", *["."] * 9, "2 July 28th", ".", "2 The End of Summer", "."), ["July 28th", "July 28th", "The End of Summer"]),
    "epigraphs": (_page(*[x for t in ("On Salt", "On Mills", "On Bells") for x in (f"2 {t}", *["<p>A line of verse</p>"] * 9, f"2 {t}", ".")]), ["On Salt", "On Mills", "On Bells"]),
    "empty title once more": (_page("2 The Miller", ".", "2 PREFACE", ".", "2 The Miller", "2 BOOK FIRST", ".", "2 BOOK SECOND", "."), ["The Miller", "PREFACE", "BOOK FIRST", "BOOK SECOND"]),
    "contents label and synopsis": (_page("2 CHAP.", "2 CHAPTER I", ".", "2 SYNOPSIS OF CHAPTER II", ".", "2 CHAPTER II", "."), ["CHAPTER I", "CHAPTER II"]),
    "speakers": (_page("2 BOOK I", ".", "3 ORLA - SILAS", ".", "3 SILAS", ".", "2 BOOK II", "."), ["BOOK I", "BOOK II"]),
    "stage cues": (_page("2 ACT I", ".", "5 NIGHT", ".", "5 ORLA", ".", "2 ACT II", "."), ["ACT I", "ACT II"]),
    "letters in a row": (_page("2 The A B C of Salt", ".", "4 A.", ".", "4 B.", ".", "2 The Mill", "."), ["The A B C of Salt", "The Mill"]),
    "numbers in small headings": (_page("2 The Ferry", ".", "4 I.", ".", "4 II.", ".", "4 III.", ".", "2 The Toll", "."), ["The Ferry", "The Toll"]),
    "author on the title page": (_page("1 Essays on Salt", ".", "5 ORLA NIGHT", ".", "2 The Ferry", ".", "2 The Toll", "."), ["Essays on Salt", "The Ferry", "The Toll"]),
    "shorter title": (_page("2 The Miller and His Mill", "2 The Miller", ".", "2 The Toll", "."), ["The Miller and His Mill", "The Toll"]),
    "stub of front matter": (_page("4 PREFACE", "2 CHAPTER I", ".", "2 CHAPTER II", "."), ["CHAPTER I", "CHAPTER II"]),
    "gap of the editor": (_page("2 CHAPTER I", ".", "2 The Fair [not in early editions]", "2 CHAPTER III", "."), ["CHAPTER I", "CHAPTER III"]),
    "contents": (_page(_contents(("a", "CHAPTER I"), ("b", "CHAPTER II")), '<h2><a id="a"></a>CHAPTER I</h2>', ".", '<h2 id="b">CHAPTER II</h2>', "."), ["CHAPTER I", "CHAPTER II"]),
    "index in one line": (
        _page('<p>Chapter: <a href="#a" class="pginternal">I.</a>, <a href="#b" class="pginternal">II.</a>, <a href="#c" class="pginternal">III.</a></p>', *[x for i in "abc" for x in (f'<h2 id="{i}">CHAPTER {"abc".index(i) + 1}</h2>', ".")]),
        ["CHAPTER 1", "CHAPTER 2", "CHAPTER 3"],
    ),
    "link with its subtitle beside": (
        _page('<p><a href="#a" class="pginternal">CHAPTER I.</a> The Ferry at Night</p><p><a href="#b" class="pginternal">CHAPTER II.</a> The Toll</p>', '<h2 id="a">CHAPTER I</h2>', ".", '<h2 id="b">CHAPTER II</h2>', "."),
        ["CHAPTER I", "CHAPTER II"],
    ),
    "links by page": (_page(_contents(("page_1", "1"), ("page_9", "9"), tag="li"), '<h2><a id="page_1"></a>The Ferry</h2>', ".", '<h2><a id="page_9"></a>The Toll</h2>', "."), ["The Ferry", "The Toll"]),
    "apparatus ends the contents": (
        _page(_contents(("a", "CHAPTER I"), ("b", "APPENDIX"), ("c", "Of the Text")), '<h2 id="a">CHAPTER I</h2>', ".", '<h2 id="b">APPENDIX</h2>', ".", '<h2 id="c">Of the Text</h2>', "."),
        ["CHAPTER I", "APPENDIX"],
    ),
}
