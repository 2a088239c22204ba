"""The best representative of each group of records of one work, by iterative truth discovery.

1. Links. Records whose titles share a rare word, or the beginning or end of one, are compared, and those of short titles
   (or main titles) that are equal but for some letters left out: the titles must agree
   word by word but for typos, missing ends and subtitles, the volumes must be equal, and the first authors must be
   readable as one (`names.same`) or one be missing. Average linkage over these pairs gives groups.
2. Truth. Each record claims a title, a first author and a volume for its group. A claim's support is the sum of the
   reliabilities of the sources that make it, claims that agree supporting one another; a source is a style of
   cataloguing (how date, language and type are written), of which there are a few hundred at most. Reliability is the mean
   share of support that a source's claims get. Both are estimated in turn until no reliability moves by more than
   `TOLERANCE`. The claim of the highest support is the group's value of the field.
3. Members whose own title, author or volume contradict the group's true values leave the group.
4. Survivors. From the members, the most complete, latest record, and by field the fullest claim.
"""

from __future__ import annotations

import itertools
import logging
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.llm.names import author_names, deletions, distance, fold, same, similar_names
from bookspark.llm.similarity import average_linkage, cosine_join, merged
from bookspark.operators.durable import cut
from bookspark.operators.layout import spread

log = logging.getLogger(__name__)
COSINE, LINKAGE, TOLERANCE = 0.15, 0.5, 1e-3
FIELDS = ["title", "authors", "language", "subjects", "locc", "bookshelves", "issued", "type"]
# Names of months, roman numerals of volumes.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx"]
_VOLUME = re.compile(r"[\s,;:(\[-]*\b(?:vol(?:ume)?|part|book|bd|tome?)\b\.?\s*([0-9]+|[ivx]+)\b[)\]]*")


_ARTICLE = r"(?:the|an?|der|die|das|le|la|les|los|las|el|il|lo)"


def _flat(title: str | None) -> str:
    """Small letters without accents, "&" as a word, without the article at the beginning or, after a comma, at the end of the title or main title."""
    flat = fold(title or "").replace("&", " and ")
    flat = re.sub(rf",\s*{_ARTICLE}\b(?=\W*$|\s*[.,:;–—\[(\n]|\s+-)", " ", flat, count=1)
    return re.sub(rf"^\W*{_ARTICLE}\s+(?=\w)", "", flat)


@lru_cache(100_000)
def title_parts(title: str | None) -> tuple[tuple[str, ...], str, bool]:
    """(words in small letters without accents or article, volume or '', whether the end is cut off)."""
    flat = _flat(title)
    volume = ""
    if m := _VOLUME.search(flat):
        volume = str(ROMAN.index(m[1]) + 1) if m[1] in ROMAN else m[1].lstrip("0") or m[1]
        flat = _flat(flat[: m.start()] + " " + flat[m.end() :])
    words = tuple(re.findall(r"[^\W_]+", re.sub(r"['’]", "", flat)))
    return words, volume, bool(re.search(r"(…|\.\.\.)\W*$", flat))


@lru_cache(100_000)
def has_article(title: str | None) -> bool:
    return _flat(title) != fold(title or "").replace("&", " and ")


def same_title(a: str | None, b: str | None) -> bool:
    """Whether two titles can be of one work; missing titles can't."""
    (x, v, cut_x), (y, w, cut_y) = title_parts(a), title_parts(b)
    if len(x) > len(y):
        x, y, v, w, cut_x, cut_y = y, x, w, v, cut_y, cut_x
    if not x or (v != w and not (v == "" and cut_x or w == "" and cut_y)):
        return False
    # the same letters but for two, where a typo has moved a space or a sign between words
    if min(sum(map(len, x)), sum(map(len, y))) > 15 and distance("".join(x), "".join(y), 2) <= 2:
        return True
    wrong = 0
    for i, (p, q) in enumerate(zip(x, y)):
        if p == q:
            continue
        if i > 1 and (i == len(x) - 1 and q.startswith(p) or i == len(y) - 1 and p.startswith(q)):
            continue  # the end of the title is missing
        if i > 1 and (i == len(x) - 1 and cut_x and len(p) > 4 and distance(p, q[: len(p)], 1) <= 1 or i == len(y) - 1 and cut_y and len(q) > 4 and distance(q, p[: len(q)], 1) <= 1):
            continue
        k = 0 if min(len(p), len(q)) < 3 else 1 if min(len(p), len(q)) < 7 else 2
        if (d := distance(p, q, k)) > k:
            return False
        wrong += d
    if len(x) < len(y) and len(x) < max(3, len(y) / 4):
        return False
    # a word of three letters alone is too short for a typo; with an article on both sides it isn't alone
    return wrong <= (4 if sum(map(len, x)) > 3 or has_article(a) and has_article(b) else 0)


@lru_cache(100_000)
def main_title(title: str | None) -> tuple[str, ...]:
    """The words before the mark that begins a subtitle; all words if there is none."""
    main = re.split(r"[:;([–—]|\s--?\s|--|,\s*or\b", _VOLUME.sub(" ", _flat(title)))[0]
    words = title_parts(main)[0]
    return words or title_parts(title)[0]


def same_main_title(a: str | None, b: str | None) -> bool:
    """Whether one title is the whole main title of the other, which has a subtitle besides; both of one volume."""
    if title_parts(a)[1] != title_parts(b)[1]:
        return False
    whole = [" ".join(title_parts(t)[0]) for t in (a, b)]
    main = [" ".join(main_title(t)) for t in (a, b)]
    return any(len(main[i].split()) == len(whole[1 - i].split()) and same_title(main[i], whole[1 - i]) for i in (0, 1))


@lru_cache(100_000)
def read_date(text: str | None) -> int:
    """yyyymmdd of a readable date, else 0; a year, or a year and a month, counts as its first day."""
    s = (text or "").strip().lower().strip("[]().,")
    y = m = d = 0
    if g := re.fullmatch(r"(\d{4})(?:[-/.](\d{1,2})(?:[-/.](\d{1,2}))?)?(?:[t ].*)?", s):
        y, m, d = int(g[1]), int(g[2] or 1), int(g[3] or 1)
    elif g := re.fullmatch(r"(\d{4})(\d{2})(\d{2})", s):
        y, m, d = map(int, g.groups())
    elif g := re.fullmatch(r"(?:(\d{1,2})(?:st|nd|rd|th)?\s+)?([a-z]{3,9})\.?,?\s+(\d{4})", s):
        y, d = int(g[3]), int(g[1] or 1)
        m = MONTHS.index(g[2][:3]) + 1 if g[2][:3] in MONTHS else 0
    elif g := re.fullmatch(r"([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})", s):
        y, d = int(g[3]), int(g[2])
        m = MONTHS.index(g[1][:3]) + 1 if g[1][:3] in MONTHS else 0
    elif g := re.fullmatch(r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", s):
        y, m, d = int(g[3]), int(g[1]), int(g[2])
        if m > 12:
            m, d = d, m
    days = [31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    return y * 10000 + m * 100 + d if y >= 1000 and 1 <= m <= 12 and 1 <= d <= days[m - 1] else 0


def _style(issued: str | None, language: str | None, kind: str | None) -> str:
    """The source of a record: how it writes date, language and type, not what it says; forms are cut to a few signs."""
    date = re.sub(r"[a-z]+", "a", re.sub(r"\d+", "0", (issued or "").strip().lower()))[:8]
    lang = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", (language or "").strip()))[:4]
    return f"{date}|{lang}|{'-' if not kind else 'l' if kind[0].islower() else 'u'}"


def _title_grams(title: str | None) -> list[str]:
    """Words of four letters or more, and their first and last five letters."""
    words = {w for w in title_parts(title)[0] if len(w) > 3}
    return sorted(words | {f"{w[:5]}-" for w in words if len(w) > 4} | {f"-{w[-5:]}" for w in words if len(w) > 4})


def _title_keys(title: str | None) -> dict[str, tuple[bool, bool]]:
    """Keys, each with whether it is of the whole title and whether it looks for others, of a title, or main title, of one or two words, or that begins with three short ones.

    Two such titles that agree have a key in common, which is of a whole title on one side and looks for others on one side.
    Words that agree share some of their first letters, as many left out as may be wrong. Beginnings that very many titles
    have ("The Salt Road of ...") are looked for only by titles of three words: longer ones must share their fourth word
    (or its beginning, where the title ends with it) or, if a space has moved, their first sixteen letters.
    """
    keys: dict[str, tuple[bool, bool]] = {}
    for words, whole in ((main_title(title), False), (title_parts(title)[0], True)):
        if not words or len(words) > 2 and max(map(len, words[:3])) > 4:
            continue
        cut_short = lambda w, head: deletions(w, 0 if len(w) < 3 else 1 if len(w) < 7 else 2, head)
        parts = [cut_short(w, 12 if len(words) == 1 else 8) for w in words[:3]]
        heads, n = [" ".join(k) for k in itertools.product(*parts)], len(words)
        keys |= {h: (whole, n < 4) for h in heads}
        if n < 4:
            continue
        w = words[3]
        same = {f"{h}={d}" for h in (heads if len(w) < 6 else ()) for d in cut_short(w, 12)} | {f"{h}:{d}" for h in (parts[0] if len(w) > 4 else ()) for d in cut_short(w, 12)}
        keys |= dict.fromkeys(same | {f"~{d}" for d in deletions("".join(words), 2, 16)}, (whole, True))
        ends = {f"{h}>{w[:i]}": i == len(w) for h in heads for i in range(1, min(len(w), 4) + 1)} | {f"{h}>>{d}": True for h in (parts[0] if len(w) > 4 else ()) for d in deletions(w, 1, 5)}
        for k, end in ends.items():
            of, looks = keys.get(k, (False, False))
            keys[k] = (of or whole, looks or end and n == 4)
    return keys


def _title_score(a: str, b: str) -> tuple[float, bool]:
    """(how surely two titles are of one work, 0 if they aren't; whether only with the author known)."""
    if same_title(a, b):
        # a volume that is cut off is a weaker tie than a known one
        return 1.0 if title_parts(a)[1] == title_parts(b)[1] else 0.6, False
    return (1.0, True) if same_main_title(a, b) else (0.0, True)


def title_form(title: str) -> str:
    """What `_title_score` depends on: titles of one form are of one work if their authors are."""
    words, volume, cut_off = title_parts(title)
    short = sum(map(len, words)) <= 3 and has_article(title)
    return f"{' '.join(words)}|{volume}|{cut_off:d}{short:d}|{' '.join(main_title(title))}"


def _far(x, y):
    """Whether two titles, as far as the shorter goes, are further apart than any that `_title_score` accepts.

    Four typos are at most eight plain edits (a swap is two), and move the end of the shorter by four letters at most.
    """
    m = F.least(F.length(x), F.length(y))
    return F.levenshtein(x.substr(F.lit(1), m), y.substr(F.lit(1), m), 12) < 0


def alike_titles(forms: DataFrame) -> DataFrame:
    """(s, t, sure, known), s <> t, both ways round, of the `forms` (form: bigint, title, words: in one string) whose titles can be of one work."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["form"], "grams": [_title_grams(t) for t in b["title"]]})

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = ((i, k, *of) for i, t in zip(b["form"], b["title"]) for k, of in _title_keys(t).items())
            while some := list(itertools.islice(found, 100_000)):
                yield pd.DataFrame(some, columns=["id", "k", "whole", "looks"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(x, y, *_title_score(s, t)) for x, y, s, t in zip(b["s"], b["t"], b["x"], b["y"])]
            yield pd.DataFrame([r for r in found if r[2]], columns=["s", "t", "sure", "known"])

    wide = spread(forms.select("form", "title"))
    near = cosine_join(cut(wide.mapInPandas(each, "id bigint, grams array<string>")), COSINE, power=2.0).select(F.col("a").alias("s"), F.col("b").alias("t"))
    # a main title alone is enough on one side only: those of two long titles needn't meet here; two hashes that meet by chance make a pair more to be scored
    keys = cut(wide.mapInPandas(short, "id bigint, k string, whole boolean, looks boolean").withColumn("k", F.xxhash64("k")))
    x, y = keys.where("looks").toDF("x", "k", "whole", "looks"), keys.toDF("y", "k", "other", "looked")
    met = merged(x, y, "k").where("x <> y and (whole or other)")
    pairs = near.union(met.select(F.least("x", "y"), F.greatest("x", "y"))).distinct()
    one, other = forms.select("form", "title", "words").toDF("s", "x", "wx"), forms.select("form", "title", "words").toDF("t", "y", "wy")
    titled = merged(merged(pairs, one, "s"), other, "t").where(~_far(F.col("wx"), F.col("wy")))
    found = cut(titled.select("s", "t", "x", "y").mapInPandas(score, "s bigint, t bigint, sure double, known boolean"))
    return found.union(found.select("t", "s", "sure", "known"))


def work_links(nodes: DataFrame, forms: DataFrame) -> DataFrame:
    """(a, b, s), a < b, of the `nodes` (id, form, author) that can be of one work: titles and first authors fit.

    Titles are compared with titles and authors with authors, so a title that very many authors have, or an author of very
    many titles, is compared once; nodes only meet on a pair of forms and a pair of authors that fit. A missing author
    fits any, as a weaker tie, unless the titles fit only with the author known.
    """
    titles = alike_titles(forms)
    titles = cut(titles.union(forms.select("form", "form", F.lit(1.0), F.lit(False))))
    named = cut(nodes.select(F.col("author").alias("name")).where("name <> ''").distinct().select(F.monotonically_increasing_id().alias("id"), "name"))
    alike = cut(similar_names(named))
    x, y = named.toDF("a", "x"), named.toDF("b", "y")
    alike = merged(merged(alike, x, "a"), y, "b").select("x", "y")
    authors = cut(alike.union(alike.select("y", "x")).union(named.select("name", "name")))
    of = merged(nodes.select(F.col("id").alias("a"), F.col("form").alias("s"), F.col("author").alias("x")), titles, "s")
    other = nodes.select(F.col("id").alias("b"), F.col("form").alias("t"), F.col("author").alias("y"))
    both = merged(merged(of.where("x <> ''"), authors, "x"), other, ["t", "y"]).where("a < b").select("a", "b", F.col("sure").alias("s"))
    one = merged(of.where("x = '' and not known"), other, "t").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (0.75 * F.col("sure") + 0.05).alias("s"))
    return both.union(one.distinct())


def _truth(claims: DataFrame) -> DataFrame:
    """(grp, field, claim, support) of the claims (id, grp, field, claim, source): support is the share of votes, 0 to 1, at convergence."""
    votes = cut(claims.groupBy("grp", "field", "claim", "source").agg(F.count("*").alias("n")))
    trust = cut(votes.select("field", "source").distinct().withColumn("trust", F.lit(0.5)))
    for turn in itertools.count():
        weighted = votes.join(trust, ["field", "source"]).withColumn("w", F.col("trust") * F.col("n"))
        support = weighted.groupBy("grp", "field", "claim").agg(F.sum("w").alias("w"))
        total = support.groupBy("grp", "field").agg(F.sum("w").alias("all"))
        share = cut(merged(support, total, ["grp", "field"]).select("grp", "field", "claim", (F.col("w") / F.col("all")).alias("support")))
        mean = merged(votes, share, ["grp", "field", "claim"]).groupBy("field", "source").agg((F.sum(F.col("n") * F.col("support")) / F.sum("n")).alias("mean"))
        # from the eighth turn on the steps are halved each time, so the estimates come to rest in any case
        step = F.lit(0.5 ** max(0, turn - 8))
        moved = merged(trust, mean, ["field", "source"]).withColumn("new", F.col("trust") + step * (F.col("mean") - F.col("trust")))
        moved = cut(moved.select("field", "source", "trust", "new"))
        most = moved.agg(F.max(F.abs(F.col("new") - F.col("trust")))).first()[0] or 0.0
        trust = moved.select("field", "source", F.col("new").alias("trust"))
        log.info("truth discovery, turn %d: the largest change of a reliability is %.2g", turn + 1, most)
        if most <= TOLERANCE:
            return share


def work_members(books: DataFrame) -> DataFrame:
    """(id, grp, filled, title_size, n_authors, date) of the records that share their work with others: links, truth, and leaving (1. to 3.)."""
    values = cut(author_names(books))
    authors = values.groupBy("id").agg(F.min_by("name", "pos").alias("author"), F.count("*").alias("n_authors"))
    filled = sum((F.when(F.trim(F.coalesce(F.regexp_replace(F.col(c), r"(?U)\s+", ""), F.lit(""))) != "", 1).otherwise(0) for c in FIELDS), F.lit(0))
    title_size = F.length(F.regexp_replace(F.coalesce("title", F.lit("")), r"[^\p{L}\p{N}]+", ""))
    base = books.select("id", "title", "issued", "language", "type", filled.alias("filled"), title_size.alias("title_size"))
    rows = cut(merged(base, authors, "id", "left").na.fill({"author": "", "n_authors": 0, "title": ""}))

    # 1. links between different (form of title, first author) records
    def form(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"title": b["title"], "text": [title_form(t) for t in b["title"]]})

    titles = rows.where(F.regexp_replace("title", r"[^\p{L}\p{N}]+", "") != "").select("title").distinct()
    titles = cut(spread(titles).mapInPandas(form, "title string, text string"))
    forms = cut(titles.groupBy("text").agg(F.min("title").alias("title")).select(F.monotonically_increasing_id().alias("form"), "text", "title"))
    of = merged(titles, forms.select("text", "form"), "text").select("title", "form")
    formed = cut(merged(rows, of, "title"))
    nodes = cut(formed.groupBy("form", "author").agg(F.min("id").alias("id")))
    groups = average_linkage(nodes.select("id"), work_links(nodes, forms.select("form", "title", F.substring_index("text", "|", 1).alias("words"))), LINKAGE)
    member = merged(formed, merged(nodes, groups, "id").select("form", "author", F.col("cluster").alias("grp")), ["form", "author"])
    size = member.groupBy("grp").agg(F.count("*").alias("members")).where("members > 1")
    member = cut(merged(member, size.select("grp"), "grp"))

    # 2. truth by votes of styles
    def claim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, g, title, author, issued, language, kind in zip(b["id"], b["grp"], b["title"], b["author"], b["issued"], b["language"], b["type"]):
                words, volume, _ = title_parts(title)
                source = _style(issued, language, kind)
                out += [(i, g, "title", " ".join(words), source), (i, g, "volume", volume, source)] + ([(i, g, "author", author, source)] if author else [])
            yield pd.DataFrame(out, columns=["id", "grp", "field", "claim", "source"])

    claims = member.select("id", "grp", "title", "author", "issued", "language", "type").mapInPandas(claim, "id bigint, grp bigint, field string, claim string, source string")
    rank = F.struct("support", F.length("claim").alias("l"), "claim")
    truth = _truth(claims).groupBy("grp").pivot("field", ["title", "author", "volume"]).agg(F.max_by("claim", rank))
    truth = truth.select("grp", F.col("title").alias("true_title"), F.coalesce("author", F.lit("")).alias("true_author"), F.col("volume").alias("true_volume"))

    # 3. members that contradict the truth leave
    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for title, author, t, a, v in zip(b["title"], b["author"], b["true_title"], b["true_author"], b["true_volume"]):
                _, volume, cut_off = title_parts(title)
                keep.append((volume == v or (not volume and cut_off) or not v) and (not author or not a or same(author, a) or author == a))
            kept = b[keep]
            yield pd.DataFrame({c: kept[c] for c in ("id", "grp", "filled", "title_size", "n_authors")} | {"date": [read_date(x) for x in kept["issued"]]})

    return merged(member, truth, "grp").mapInPandas(agree, "id bigint, grp bigint, filled int, title_size int, n_authors bigint, date bigint")


def best_records(books: DataFrame) -> DataFrame:
    """(group_id, survivor_id, title_id, authors_id, issued_id) of each work that is listed under two or more ids; one row a work.

    `books` has the unique bigint `id` and FIELDS. Rows without a title are in no group. Blank and null fields count as missing.
    `issued_id` is 0 if no member has a readable date.
    """
    kept = work_members(books)
    # 4. survivors, each on ties the smaller id
    small = (-F.col("id")).alias("i")
    out = kept.groupBy("grp").agg(
        F.count("*").alias("members"),
        F.min("id").alias("group_id"),
        F.max_by("id", F.struct("filled", "date", small)).alias("survivor_id"),
        F.max_by("id", F.struct("title_size", small)).alias("title_id"),
        F.max_by("id", F.struct("n_authors", small)).alias("authors_id"),
        F.max_by(F.when(F.col("date") > 0, F.col("id")).otherwise(F.lit(0)), F.struct("date", small)).alias("issued_id"),
    )
    return out.where("members > 1").select("group_id", "survivor_id", "title_id", "authors_id", "issued_id")
