"""Markup residue in texts: clean text that keeps headings, lists, verse, tables, code and formulas.

A text is read once, left to right, into leaves: each piece of text with the path of structural tags above it, whatever
the notation (HTML, Markdown, wiki, LaTeX). Signs that only show (italics, links, entities) lie in no path: their text
belongs to the leaf around them.

Which paths hold content is decided over all records by tag-path ratios: for each path the length of its text and its
punctuation, by occurrence of the path; both are smoothed with those of the path above it and of all paths (a path seen
seldom counts little), fused to one score, and the paths below a threshold are left out (style sheets, page numbers,
navigation, notices around the text, templates). Headings, lists, tables, code and formulas are structure and always stay.
The table of paths is summed and scored in the executors. Of a path deeper than twice `ENDS` the first and last `ENDS` tags
count, besides the outermost tag of structure between them; classes are cut at a few signs. The `PATHS` most frequent paths
are broadcast; the verdicts on others are joined to the records that have them, so every path has its own score.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.operators.durable import cut
from bookspark.operators.layout import spread

ENDS, PATHS, SMOOTH, THRESHOLD = 3, 1 << 16, 20.0, 0.9
# Names of tags by what they do, commands of LaTeX.
SHOW = set("a abbr acronym b bdi bdo big center cite code del dfn em font i ins kbd mark nobr nowiki q s samp small span strike strong sub sup tt u var wbr".split())
BLOCKS = set("address article aside blockquote body caption col colgroup dd details div dl dt fieldset figcaption figure footer form head header hr html legend li main map menu meta nav ol p poem pre section summary table tbody td tfoot th thead title tr ul h1 h2 h3 h4 h5 h6 br img link input button label select option iframe object param embed area base video audio source noscript center".split())
RAW = ("style", "script", "ref", "math", "gallery", "timeline", "references", "poem", "onlyinclude", "includeonly", "noinclude", "section", "pages", "hiero", "score", "syntaxhighlight", "source")
TAGS = SHOW | BLOCKS | set(RAW)
STRUCTURE = set("h1 h2 h3 h4 h5 h6 li dt dd td th caption pre code poem".split())
VOID = set("br hr img link meta input col param embed area base wbr source references pages".split())
TEX_HEADS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "title": 1}
TEX_SHOW = set("it bf sc em rm tt sl sf itshape bfseries scshape textit textbf textsc emph textrm texttt textsl textsf textup underline uppercase lowercase mbox hbox small large Large huge Huge tiny footnotesize normalsize centering".split())
TEX_NOTES = set("footnote footnotetext marginpar thanks index label ref pageref cite input include usepackage documentclass vspace hspace pagestyle thispagestyle setcounter addcontentsline bibliography bibliographystyle".split())
TEX_OTHER = set("begin end item noindent indent par newpage clearpage pagebreak linebreak newline bigskip medskip smallskip ldots dots maketitle tableofcontents hfill vfill dag ddag copyright aa ae oe ss quad qquad hline footnotemark today LaTeX TeX".split())

_ATTR = r"""(?:\s+[A-Za-z_:][-\w:.]*(?:\s*=\s*(?:"[^"<]*"|'[^'<]*'|[^\s"'=<>`]+)))*"""
_BARE = r"(?:\s+(?:checked|disabled|noshade|nowrap|compact|selected|hidden|async|defer))*"
_PATTERN = re.compile(
    rf"""
    (?P<comment><!--.*?-->|<!doctype[^>]*>|<\?xml[^>]*>)
  | (?P<raw><(?P<rawname>style|script|ref|math)\b{_ATTR}\s*(?:/>|>(?P<rawtext>.*?)</(?P=rawname)\s*>))
  | (?P<tag><(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9]*){_ATTR}{_BARE}\s*/?>)
  | (?P<auto><(?:https?|ftp|mailto):[^\s<>]+>)
  | (?P<entity>&(?:\#\d{{1,7}}|\#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,30}});)
  | (?P<fence>^[ ]{{0,3}}(?P<ticks>```+|~~~+)[^\n`]*\n(?P<fenced>.*?)(?:^[ ]{{0,3}}(?P=ticks)[ ]*$|\Z))
  | (?P<tick>`(?P<ticked>[^`\n]+)`)
  | (?P<wtable>^\{{\|.*?^\|\}})
  | (?P<template>\{{\{{[^{{}}]*\}}\}})
  | (?P<wlink>\[\[(?:[^\[\]|\n]*\|)?(?P<wtext>(?:(?!\n\s*\n)[^\[\]|])+)\]\])
  | (?P<xlink>\[(?:https?|ftp)://[^\s\]]+(?:[ ](?P<xtext>[^\]\n]*))?\])
  | (?P<mlink>(?P<image>!?)\[(?P<mtext>(?:(?!\n\s*\n)[^\[\]])*)\]\((?:[^()\s]+|<[^<>\n]*>)(?:[ ]+"[^"\n]*")?\))
  | (?P<rlink>(?<!\w)\[(?P<rtext>[^\[\]\n]+)\]\[[^\[\]\n]+\])
  | (?P<define>^[ ]{{0,3}}\[[^\]\n]+\]:[ ]+\S+.*$)
  | (?P<whead>^(?P<eq>={{2,6}})[ ]*(?P<wtitle>[^=\n].*?)[ ]*(?P=eq)[ ]*$)
  | (?P<mhead>^[ ]{{0,3}}(?P<hashes>\#{{1,6}})[ ]+(?P<mtitle>\S.*?)[ ]*\#*$)
  | (?P<mtable>(?:^[ ]{{0,3}}\|.*\|[ ]*\n)^[ ]{{0,3}}\|?[ ]*:?-{{2,}}:?[ ]*(?:\|[ ]*:?-{{2,}}:?[ ]*)*\|?[ ]*(?:\n[ ]{{0,3}}\|.*\|[ ]*$)*)
  | (?P<quote>^[ ]{{0,3}}>(?:[ ]|$))
  | (?P<wquote>(?P<apo>'{{2,5}})(?P<wshown>(?:(?!\n\s*\n)[^'])+(?:'(?!')(?:(?!\n\s*\n)[^'])+)*)(?P=apo)(?!'))
  | (?P<nothing>(?<![\w_])__\ __(?![\w_])|(?<!')''''(?!'))
  | (?P<emph>(?<![\w*\\])(?P<stars>\*{{1,3}})(?=[^\s*])(?P<shown>(?:(?!\n\s*\n)[^*])+?)(?<=[^\s*])(?P=stars)(?![\w*]))
  | (?P<under>(?<![\w_\\])(?P<bars>_{{1,3}})(?=[^\s_])(?P<ushown>(?:(?!\n\s*\n)[^_])+?)(?<=[^\s_])(?P=bars)(?![\w_]))
  | (?P<strike>~~(?=\S)(?P<struck>[^~\n]+?)(?<=\S)~~)
  | (?P<formula>\$\$(?P<display>[^$]+)\$\$|\\\[(?P<bracket>.+?)\\\]|\\\((?P<paren>.+?)\\\)|(?<![\w\\$])\$(?=[^\s$])(?P<inline>[^$\n]*[\\^_{{}}][^$\n]*)(?<=[^\s\\])\$(?!\d))
  | (?P<env>\\(?:begin|end)\{{(?P<envname>[^{{}}\n]*)\}}(?:\[[^\]\n]*\]|\{{[^{{}}\n]*\}})*)
  | (?P<braced>\{{\\(?P<switch>[A-Za-z]+)(?![A-Za-z])[ ]*)
  | (?P<command>\\(?P<cname>[A-Za-z]+)\*?(?:\[[^\]\n]*\])?(?P<open>\{{)?)
  | (?P<texsign>\\/|\\\\(?=\s|$|\[)|\\[&%$\#_{{}}~^"'`=.](?:\{{?(?P<accented>[A-Za-z])\}}?)?)
  | (?P<bullet>^[ ]{{0,6}}(?P<mark>[-+*]|[*\#:;]{{1,4}}(?=[ ][^\s*])|\d{{1,3}}[.)])[ ]+(?=\S))
    """,
    re.X | re.M | re.S | re.I,
)
#: Where a sign can begin; every other place is skipped at once.
_START = re.compile(r"[<`{\\$]|&[\#A-Za-z]|!?\[(?=\[|[^\]]*\]|(?:https?|ftp)://)|\*+(?=\S)|_+(?=\S)|~~|''|__ __|^[ ]{0,6}[-=\#|>+*~]", re.M)
#: The same for the JVM: a text without any of these holds no markup.
SIGNS = "(?m)" + _START.pattern
_ACCENTS = {'"': "̈", "'": "́", "`": "̀", "^": "̂", "~": "̃", "=": "̄", ".": "̇"}


class Reading:
    """What a text holds: leaves (path, kind, text) and the number of signs of markup."""

    __slots__ = ("leaves", "signs", "_path", "_close")

    def __init__(self, text: str):
        self.leaves: list[tuple[tuple[str, ...], str, str]] = []
        self.signs = 0
        self._path: list[str] = []
        self._close: list[str] = []  # ends of open braces, innermost last
        self._read(text)

    def _add(self, text: str, kind: str = "", *tags: str) -> None:
        if text:
            path = (*self._path, *tags)
            if len(path) > 2 * ENDS:
                path = path[:ENDS] + tuple(t for t in path[ENDS:-ENDS] if t in STRUCTURE)[:1] + path[-ENDS:]
            self.leaves.append((path, kind, text))

    def _inner(self, text: str, kind: str = "", *tags: str) -> None:
        """Text within a sign, that may hold signs of its own."""
        sub = Reading(text)
        for path, k, t in sub.leaves:
            self._add(t, k or kind, *tags, *path)

    def _text(self, text: str) -> None:
        """Plain text, with the ends of LaTeX groups that it closes."""
        if not self._close or "}" not in text:
            self._add(text)
            return
        begin, depth = 0, 0
        for m in re.finditer(r"[{}]", text):
            if m[0] == "{":
                depth += 1
            elif depth:
                depth -= 1
            elif self._close:
                self._add(text[begin : m.start()])
                begin = m.end()
                if (end := self._close.pop()) != "-":
                    self._path.pop()
                    if end == "head":
                        self._add("\n", "break")
        self._add(text[begin:])

    def _read(self, text: str) -> None:
        at = 0
        bullets = len(re.findall(r"(?m)^ {0,6}(?:[-+*])[ ]+\S", text))
        start = 0
        while s := _START.search(text, start):
            m = _PATTERN.match(text, s.start()) or (_PATTERN.match(text, s.end() - 1) if s.end() - s.start() > 1 else None)
            start = s.end()
            if m is None:
                continue
            kind = next(k for k in _KINDS if m[k] is not None)
            if not self._is(kind, m, bullets, text):
                continue
            self._text(text[at : m.start()])
            at = m.end()
            start = max(at, m.start() + 1)
            self.signs += 1
            self._sign(kind, m)
        self._text(text[at:])

    def _is(self, kind: str, m: re.Match, bullets: int, text: str) -> bool:
        """Whether what looks like a sign is one."""
        if kind == "tag":
            return m["name"].lower() in TAGS
        if kind == "entity":
            return m[0][1] == "#" or m[0][1:] in html.entities.html5
        if kind == "command":
            known = m["cname"] in TEX_HEADS or m["cname"] in TEX_SHOW or m["cname"] in TEX_NOTES or m["cname"] in TEX_OTHER
            before = text[m.start() - 1 : m.start()]
            return bool(m["open"]) and not before.isalnum() or known and not before.isalnum()
        if kind == "braced":
            return True
        if kind == "bullet":
            return bullets > 1 and m["mark"] in ("-", "+", "*")
        if kind == "texsign":
            return m[0] not in ("\\'", '\\"') or bool(m["accented"])
        if kind == "wquote":
            return len(m["apo"]) != 4
        if kind == "under":
            return any(c.isalnum() for c in m["ushown"])
        if kind == "emph":
            return any(c.isalnum() for c in m["shown"])
        return True

    def _sign(self, kind: str, m: re.Match) -> None:
        if kind == "tag":
            self._tag(m)
        elif kind == "raw":
            name = m["rawname"].lower()
            if m["rawtext"]:
                self._add(m["rawtext"], "formula" if name == "math" else "", name)
        elif kind == "entity":
            self._add(html.unescape(m[0]))
        elif kind == "auto":
            self._add(m[0][1:-1])
        elif kind == "fence":
            self._add(m["fenced"], "code", "fence")
        elif kind == "tick":
            self._add(m["ticked"], "ticked")
        elif kind in ("wtable", "mtable"):
            rows = [re.sub(r"\{\|.*|\|[-}+].*", "", x) for x in m[0].split("\n")] if kind == "wtable" else [x for x in m[0].split("\n") if re.search(r"[^\s|:\-]", x)]
            cells = [[c.strip() for c in re.split(r"\|\||!!|\|", re.sub(r"^\s*[|!]|\|\s*$", "", x))] for x in rows]
            for row in cells:
                if any(row):
                    self._add(" | ".join(row) + "\n", "row", "table")
        elif kind == "template":
            self._add(m[0][2:-2], "", "template")
        elif kind in ("wlink", "xlink", "rlink"):
            self._inner(m[kind[0] + "text"] or "")
        elif kind == "mlink":
            self._inner(m["mtext"], "", *(["image"] if m["image"] else []))
        elif kind == "define":
            self._add(m[0], "", "define")
        elif kind in ("whead", "mhead"):
            level = len(m["eq"] or m["hashes"])
            self._inner(m["wtitle"] or m["mtitle"], f"h{level}", f"h{level}")
        elif kind == "quote":
            self._add("", "")
        elif kind in ("wquote", "emph", "under", "strike"):
            self._inner(m["wshown"] or m["shown"] or m["ushown"] or m["struck"] or "")
        elif kind == "formula":
            self._add(m["display"] or m["bracket"] or m["paren"] or m["inline"], "formula")
        elif kind == "env":
            self._add("\n", "break")
        elif kind == "braced":
            self._close.append("-")
        elif kind == "command":
            self._command(m)
        elif kind == "texsign":
            sign = m[0][1]
            if m["accented"] and sign in _ACCENTS:
                self._add(m["accented"] + _ACCENTS[sign])
            elif sign not in "/\\":
                self._add(sign + (m["accented"] or ""))
            elif sign == "\\" and not m.string.startswith("\n", m.end()):
                self._add("\n")
        elif kind == "bullet":
            self._add("- ", "item", "li")

    def _command(self, m: re.Match) -> None:
        c = m["cname"]
        if c == "item":
            self._add("\n- ", "item", "li")
        if not m["open"]:
            return
        if c in TEX_HEADS:
            self._path.append(f"h{TEX_HEADS[c]}")
            self._close.append("head")
        elif c in TEX_NOTES:
            self._path.append(c)
            self._close.append("note")
        else:
            self._close.append("-")

    def _tag(self, m: re.Match) -> None:
        name = m["name"].lower()
        attrs = m[0]
        mark = re.search(r"""\b(?:class|id)\s*=\s*["']?([A-Za-z]+(?:-[A-Za-z]+)?)""", attrs)
        label = f"{name}.{mark[1][:12].lower()}" if mark and name in ("span", "div", "p", "section", "table", "ul", "nav", "a") and not m["close"] else name
        if name == "br":
            self._add("\n", "break")
        elif name == "img":
            alt = re.search(r"""\balt\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S+))""", attrs)
            self._add(next((g for g in alt.groups() if g), "") if alt else "", "", "img")
        elif name in VOID:
            self._add("\n", "break")
        elif m["close"]:
            at = next((i for i in range(len(self._path) - 1, -1, -1) if self._path[i].split(".")[0] == name), None)
            if at is not None:
                del self._path[at:]
            if name not in SHOW:
                self._add("\n", "break")
        elif name in SHOW and not (name == "span" and mark):
            return
        elif not m[0].endswith("/>"):
            if name in ("p", "li", "td", "th", "tr", "dd", "dt", "option"):  # their ends may be missing
                at = next((i for i in range(len(self._path) - 1, -1, -1) if self._path[i].split(".")[0] == name), None)
                stop = next((i for i in range(len(self._path) - 1, -1, -1) if self._path[i].split(".")[0] in ("ul", "ol", "table", "tr" if name != "tr" else "table", "div", "section")), -1)
                if at is not None and at > stop:
                    del self._path[at:]
            elif name in BLOCKS and self._path and self._path[-1].split(".")[0] == "p":
                self._path.pop()
            if name not in SHOW:
                self._add("\n", "break")
            self._path.append(label)
            if name == "li":
                self._add("- ", "item")


_KINDS = "comment raw tag auto entity fence tick wtable template wlink xlink mlink rlink define whead mhead mtable quote wquote nothing emph under strike formula env braced command texsign bullet".split()


def structure(path: tuple[str, ...], kind: str) -> str:
    """The kept structure that a leaf belongs to, or ''."""
    if kind in ("code", "ticked", "formula", "item", "row", "break"):
        return kind
    for t in path:
        if t in STRUCTURE:
            return t
    return ""


def scores(sums: DataFrame) -> DataFrame:
    """(path, n, score) of all paths from (path, n, letters, points): fused and smoothed ratios."""
    cols = ("n", "letters", "points")
    tag = F.substring_index("path", "/", -1)
    last = sums.groupBy(tag.alias("last")).agg(*[F.sum(c).alias(f"of_{c}") for c in cols])
    every = sums.agg(*[F.sum(c).alias(f"all_{c}") for c in cols])
    rows = sums.withColumn("last", tag).join(last, "last").crossJoin(F.broadcast(every))
    for c in cols[1:]:
        # towards all paths that end in the same tag, and these towards all paths
        mean = (F.col(f"of_{c}") + F.col(f"all_{c}") / F.greatest("all_n", F.lit(1))) / (F.col("of_n") + 1)
        rows = rows.withColumn(f"smooth_{c}", (F.col(c) + SMOOTH * mean) / (F.col("n") + SMOOTH))
    # one is what text under no tag, or else all text, has
    bare = rows.where("path = ''").agg(*[F.max(f"smooth_{c}").alias(f"bare_{c}") for c in cols[1:]])
    rows = rows.crossJoin(F.broadcast(bare))
    norm = lambda c: F.greatest(F.coalesce(f"bare_{c}", F.col(f"all_{c}") / F.greatest("all_n", F.lit(1))), F.lit(1e-9))
    part = lambda c: F.least(F.lit(1.0), F.log1p(f"smooth_{c}") / F.log1p(norm(c)))
    return rows.select("path", "n", (0.6 * part("letters") + 0.4 * part("points")).alias("score"))


def render(r: Reading, dropped: frozenset[str]) -> str:
    """The text of the leaves on content paths, structure in plain notation."""
    out: list[str] = []
    heading = None
    for path, kind, text in r.leaves:
        s = structure(path, kind)
        if not s and "/".join(path) in dropped:
            continue
        if s == "break":
            out.append("\n")
            heading = None
            continue
        if re.fullmatch(r"h[1-6]", s):
            if heading is None:
                out.append("#" * int(s[1]) + " ")
            heading = s
        else:
            heading = None
        if s == "code" or s == "pre":
            text = f"```\n{text.strip(chr(10))}\n```"
        elif s == "ticked":
            text = f"`{text}`"
        elif s == "formula":
            text = f"${text}$"
        elif s in ("td", "th"):
            text = text.strip() + " | " if text.strip() else ""
        out.append(text)
    lines = [x.rstrip() for x in "".join(out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def plain(r: Reading, dropped: frozenset[str]) -> str:
    """The text of the leaves on content paths as it is, without any notation of structure."""
    return "".join(t for path, kind, t in r.leaves if kind not in ("item", "break") and (structure(path, kind) or "/".join(path) not in dropped))


def _judged(marked: DataFrame) -> tuple[DataFrame, Broadcast]:
    """`marked` (text: not null, others) with `bad`, the dropped paths of a row that aren't sent to all; and the verdicts on those that are."""
    spark = marked.sparkSession

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter = Counter()
            for t in b["text"]:
                r = Reading(t)
                if r.signs:
                    for path, kind, s in r.leaves:
                        if not structure(path, kind):
                            p = "/".join(path)
                            n[p, 0] += 1
                            n[p, 1] += sum(map(str.isalnum, s))
                            n[p, 2] += sum(s.count(c) for c in ",.;:!?—–")
            paths = sorted({p for p, _ in n})
            yield pd.DataFrame([(p, n[p, 0], n[p, 1], n[p, 2]) for p in paths], columns=["path", "n", "letters", "points"])

    sums = marked.select("text").mapInPandas(count, "path string, n bigint, letters bigint, points bigint").groupBy("path").agg(*[F.sum(c).alias(c) for c in ("n", "letters", "points")])
    scored = cut(scores(cut(sums)))
    # the most frequent paths are sent to all; the verdicts on others are joined to the records that have them
    known = {r["path"]: r["path"] != "" and r["score"] < THRESHOLD for r in scored.orderBy(F.desc("n"), "path").limit(PATHS + 1).collect()}
    more = len(known) > PATHS
    hot = spark.sparkContext.broadcast(dict(list(known.items())[:PATHS]))

    def rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(paths=[sorted({p for path, kind, _ in Reading(t).leaves if not structure(path, kind) and (p := "/".join(path)) not in hot.value}) for t in b["text"]])

    if not more:
        return marked.withColumn("bad", F.lit(None).cast("array<string>")), hot
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in marked.schema)
    read = cut(marked.mapInPandas(rare, f"{fields}, paths array<string>").withColumn("row", F.monotonically_increasing_id()))
    bad = read.select("row", F.explode("paths").alias("path")).join(scored.where((F.col("path") != "") & (F.col("score") < THRESHOLD)).select("path"), "path")
    return read.drop("paths").join(bad.groupBy("row").agg(F.collect_list("path").alias("bad")), "row", "left").drop("row"), hot


def clean_records(df: DataFrame, key: str, text: str, group: str | None = None) -> DataFrame:
    """(`group`,) `key`, n_markup, clean of every row: the number of signs of markup, and the text without them.

    A null text gives null and 0, a text without markup itself. Repeated rows come out repeated; extra columns don't matter.
    """
    keys = ([group] if group else []) + [key]
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    rows = df.select(*keys, F.col(text).alias("text"))
    marked, hot = _judged(spread(rows.where(F.col("text").rlike(SIGNS))))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dropped = frozenset(p for p, x in hot.value.items() if x)
        for b in batches:
            found = [Reading(t) for t in b["text"]]
            out = [render(r, dropped if bad is None else dropped | set(bad)) if r.signs else t for r, t, bad in zip(found, b["text"], b["bad"])]
            yield pd.DataFrame({**{k: b[k] for k in keys}, "n_markup": [r.signs for r in found], "clean": out})

    done = marked.mapInPandas(clean, f"{schema}, n_markup int, clean string")
    plain = rows.where(F.col("text").isNull() | ~F.col("text").rlike(SIGNS)).select(*keys, F.lit(0).alias("n_markup"), F.col("text").alias("clean"))
    return done.unionByName(plain)


def _both(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(tbl, rec_id, content) of both tables."""
    t = texts.select(F.lit("texts").alias("tbl"), F.col("book_id").alias("rec_id"), "content")
    c = chunks.select(F.lit("chunks").alias("tbl"), F.col("id").alias("rec_id"), "content")
    return t.unionByName(c)


def clean_corpus(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(tbl, rec_id, n_markup, clean) of both tables, with one table of paths."""
    return clean_records(_both(texts, chunks), "rec_id", "content", "tbl")


def marked_records(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(tbl, rec_id) of the records that hold markup: those that differ from their text on content paths, notation left out.

    Paths are scored over all records of both tables, as in `clean_corpus`. Every sign takes something out of the text, so
    a record in which a sign is read differs whatever the scores are.
    """
    rows = _both(texts, chunks).withColumnRenamed("content", "text")
    marked, hot = _judged(spread(rows.where(F.col("text").rlike(SIGNS))))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dropped = frozenset(p for p, x in hot.value.items() if x)
        for b in batches:
            yield b.loc[[plain(Reading(t), dropped if bad is None else dropped | set(bad)) != t for t, bad in zip(b["text"], b["bad"])], ["tbl", "rec_id"]]

    return marked.mapInPandas(found, f"tbl string, rec_id {rows.schema['rec_id'].dataType.simpleString()}")
