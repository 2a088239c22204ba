"""Variant spellings of names: which mean the same person or body.

Each different name becomes a vector of the runs of four characters of all its words, its initials and its life dates, weighted
by rarity. A sparse join finds every pair whose cosine is at least `COSINE`, as many partners as there are (or the `top`
nearest). Average linkage over the cosines makes the groups, down to a mean of `LINKAGE`: a name that fits two persons goes
to the nearer one and doesn't join the two. Rules only forbid: a pair that can't be read as one name (other given names,
contradicting life dates, other bodies; see `same`) has cosine 0, however alike its letters are.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.llm.similarity import average_linkage, cosine_join, merged
from bookspark.operators.durable import cut
from bookspark.operators.layout import spread
from bookspark.operators.packed import split_packed

COSINE, LINKAGE, GRAM = 0.3, 0.22, 4
# Familiar and shortened forms of given names (some of several), forms of address, words of bodies and their abbreviations.
NICKNAMES = {
    "archie": "archibald", "gus": "augustus", "bert": "albert herbert robert", "al": "albert alexander", "alex": "alexander", "alec": "alexander", "sandy": "alexander", "annie": "anne", "nan": "anne", "nancy": "anne",
    "bas": "basil", "ben": "benjamin", "benny": "benjamin", "bella": "isabella", "belle": "isabella", "kate": "catherine", "kitty": "catherine", "cathy": "catherine", "charlie": "charles",
    "chuck": "charles", "kit": "christopher catherine", "chris": "christopher", "clem": "clement", "dolly": "dorothy", "dot": "dorothy", "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "edward theodore", "teddy": "theodore edward",
    "bess": "elizabeth", "beth": "elizabeth", "betsy": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "lizzie": "elizabeth", "liz": "elizabeth", "fanny": "frances", "frank": "francis",
    "fred": "frederick alfred", "freddie": "frederick alfred", "gil": "gilbert", "hal": "henry", "harry": "henry harold", "nell": "helen eleanor", "nellie": "helen eleanor", "jim": "james", "jimmy": "james", "jamie": "james", "jack": "john", "johnny": "john",
    "joe": "joseph", "jo": "josephine joseph", "josie": "josephine", "larry": "lawrence", "lou": "louis", "len": "leonard", "leo": "leonard", "maggie": "margaret", "meg": "margaret", "peg": "margaret", "peggy": "margaret", "daisy": "margaret",
    "molly": "mary", "polly": "mary", "patty": "martha patricia", "mattie": "martha", "tilly": "matilda", "tilda": "matilda", "nat": "nathaniel", "nate": "nathaniel", "percy": "percival", "dick": "richard", "rick": "richard",
    "bob": "robert", "rob": "robert", "robbie": "robert", "robin": "robert", "sam": "samuel", "sammy": "samuel", "sally": "sarah", "sadie": "sarah", "theo": "theodore", "tom": "thomas", "tommy": "thomas", "bill": "william",
    "billy": "william", "will": "william", "willie": "william", "mina": "wilhelmina", "minnie": "wilhelmina mary", "willa": "wilhelmina", "winnie": "winifred", "freda": "winifred",
    "chas": "charles", "jos": "joseph", "geo": "george", "wm": "william", "thos": "thomas", "jas": "james", "jno": "john", "robt": "robert", "edw": "edward", "benj": "benjamin", "saml": "samuel", "danl": "daniel", "richd": "richard", "fredk": "frederick", "nathl": "nathaniel", "alexr": "alexander",
}
ADDRESS = {"sir", "dr", "mr", "mrs", "miss", "ms", "rev", "reverend", "prof", "professor", "lady", "lord", "dame", "capt", "captain", "hon", "col", "major", "st", "saint"}
BODIES = {
    "society": "society", "soc": "society", "guild": "guild", "company": "company", "co": "company", "comp": "company", "college": "college", "coll": "college", "brotherhood": "brotherhood", "bros": "brotherhood",
    "association": "association", "assoc": "association", "assn": "association", "institute": "institute", "inst": "institute", "institution": "institution", "academy": "academy", "acad": "academy", "university": "university",
    "univ": "university", "library": "library", "lib": "library", "league": "league", "union": "union", "club": "club", "board": "board", "committee": "committee", "council": "council", "church": "church", "museum": "museum",
    "historical": "historical", "hist": "historical", "office": "office", "press": "press", "department": "department", "dept": "department", "bureau": "bureau", "order": "order", "fellowship": "fellowship",
}
HEADS = {"society", "guild", "company", "college", "brotherhood", "association", "institute", "institution", "academy", "university", "league", "union", "club", "board", "committee", "council", "church", "museum", "office", "press", "department", "bureau", "order", "fellowship"}
SMALL = {"of", "the", "and", "for", "in", "at", "a", "an"}


def clean_name(item):
    """Column: a name without a role in square brackets at its end, each run of spaces one."""
    return F.trim(F.regexp_replace(F.regexp_replace(item, r"\s*\[[^\]]*\]\s*$", ""), r"(?U)\s+", " "))


def fold(s: str) -> str:
    """Small letters without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c))


@lru_cache(100_000)
def distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours between the words, or `most` + 1 if there are more than `most`."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, older[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        older, old = old, new
    return old[-1]


def _slack(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return 0 if n < 4 else 1 if n < 8 else 2


def _scanned(w: str) -> str:
    """The word with signs that scanning mistakes for one another made one."""
    return re.sub("rn", "m", re.sub("li|ii|lı", "h", w)).replace("1", "l").replace("0", "o").replace("vv", "w").replace("cl", "d")


def _alike(a: str, b: str) -> bool:
    """Whether two words may be one, but for a typo or a sign misread by scanning."""
    if a == b:
        return True
    k = _slack(a, b)
    if k and distance(a, b, k) <= k:
        return True
    scanned = [_scanned(a), _scanned(b)]
    return scanned != [a, b] and k > 0 and distance(*scanned, 1) <= (0 if k == 1 else 1)


def deletions(w: str, most: int, head: int = 12) -> set[str]:
    """The first `head` letters of the word without up to `most` of them, whichever they are.

    Two words within `most` edits have one in common, whatever their lengths: a change or a swap leaves one letter out of
    both, and an insertion moves one letter over the end of the head.
    """
    h = w[:head]
    return {"".join(c for i, c in enumerate(h) if i not in out) for k in range(min(most, len(h)) + 1) for out in itertools.combinations(range(len(h)), k)}


def _unshortened(w: str) -> str:
    """The only word of bodies of which `w` has some letters in their order, the first among them; else `w`."""
    if w in ADDRESS:
        return w
    found = {x for x in BODIES.values() if x[0] == w[0] and re.search(".*".join(w), x)}
    return found.pop() if len(found) == 1 else w


class Name:
    """A name taken apart: a body's words, or a person's readings (surname, given names), life dates, junior."""

    __slots__ = ("body", "words", "readings", "birth", "death", "junior")

    def __init__(self, text: str):
        flat = fold(text)
        years = re.search(r"(?:(?:\bb\.?\s*|\bborn\s*)(\d{4})|(\d{4})\??\s*-\s*(\d{4})?\??|-\s*(\d{4})\??)\s*$|\bd\.?\s*(\d{4})", flat)
        self.birth = self.death = ""
        if years:
            self.birth, self.death = years[1] or years[2] or "", years[3] or years[4] or years[5] or ""
            flat = flat[: years.start()].rstrip(" ,")
        words = [w for w in re.findall(r"[^\W_]+(?:['’][^\W_]+)?", flat)]
        words = [re.sub(r"['’]s?$|['’]", "", w) for w in words]
        short = set(re.findall(r"([^\W\d_]+)\.", flat))
        known = [BODIES.get(w) or (_unshortened(w) if w in short and len(w) > 1 else w) for w in words]
        self.body = bool(set(known) & HEADS) and (len(words) > 2 or "of" in words)
        self.junior = bool(re.search(r"\bjr\b|\bjunior\b|\bii\b", flat))
        self.words = sorted(w for w in known if w not in SMALL and len(w) > 1) if self.body else []
        self.readings: list[tuple[str, tuple[str, ...]]] = []
        if self.body:
            return
        drop = ADDRESS | {"jr", "sr", "junior", "senior", "ii"}
        full = re.search(r"\(([^)]*)\)", flat)
        flat = re.sub(r"\([^)]*\)", " ", flat)
        nick = re.search(r"[\"“”]([^\"“”]+)[\"“”]", flat)
        flat = re.sub(r"[\"“”][^\"“”]*[\"“”]", " ", flat) if nick else flat
        get = lambda s: tuple(w for w in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", s) if w not in drop)
        if "," in flat:
            last, _, rest = flat.partition(",")
            given = get(full[1]) if full else get(rest.partition(",")[0] if get(rest.partition(",")[0]) else rest)
            surname = get(last)
            if surname:
                self.readings.append((" ".join(surname), given))
            return
        w = get(flat)
        if len(w) == 1:
            self.readings.append((w[0], ()))
        elif w:
            self.readings.append((w[-1], get(full[1]) if full else w[:-1]))
            if len(w[0]) > 1:
                self.readings.append((w[0], w[1:]))


name = lru_cache(100_000)(Name)


def full_names(given: str) -> list[str]:
    """The given names that a form may stand for; itself if it isn't a familiar form."""
    return NICKNAMES.get(given, given).split()


def _given(a: str, b: str) -> bool:
    if len(a) == 1 or len(b) == 1:
        return a[0] == b[0]
    if any(x == y or _alike(x, y) for x in full_names(a) for y in full_names(b)):
        return True
    # a typo in a name of three letters, if it makes it longer
    return min(len(a), len(b)) == 3 < max(len(a), len(b)) and a[0] == b[0] and distance(a, b, 1) == 1


def _givens(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """The first given names agree, the others as far as both have them."""
    if not a or not b:
        return False
    if all(_given(x, y) for x, y in zip(a, b)):
        return True
    # one short typed run of initials, "RA" for "R. A."
    short, long = sorted((a, b), key=len)
    return len(short) == 1 and len(long) > 1 and len(short[0]) == len(long) and all(c == w[0] for c, w in zip(short[0], long))


def same(a: str, b: str) -> bool:
    """Whether two names can mean the same person or body."""
    x, y = name(a), name(b)
    if x.body != y.body:
        return False
    if x.body:
        if len(x.words) != len(y.words):
            return False
        left = list(y.words)
        for w in sorted(x.words, key=len, reverse=True):
            hit = next((v for v in left if v == w), None) or next((v for v in left if _alike(v, w)), None)
            if hit is None:
                return False
            left.remove(hit)
        return True
    if x.birth and y.birth and x.birth != y.birth or x.death and y.death and x.death != y.death:
        return False
    dated = bool(x.birth and x.birth == y.birth and (x.death == y.death or not (x.death and y.death)))
    if x.junior != y.junior and not dated:
        return False
    # names of one word are the same only if the word is
    return any(_alike(s, t) and _givens(g, h) if g or h else s == t for s, g in x.readings for t, h in y.readings)


def grams(text: str) -> list[str]:
    """Runs of `GRAM` characters of the name's words, from the mark before to the mark behind each, initials, and years."""
    n = name(text)
    words = set(n.words) if n.body else {w for s, g in n.readings for w in (*s.split(), *(full for x in g for full in full_names(x)))}
    out = {p[i : i + GRAM] for w in words if len(w) > 1 for p in [f"#{w}#"] for i in range(max(1, len(p) - GRAM + 1))}
    first = set() if n.body else {f".{w[0]}" for w in words}
    return sorted(out | first | {f"b{n.birth}", f"d{n.death}"} - {"b", "d"})


def similar_names(rows: DataFrame, top: int | None = None) -> DataFrame:
    """(a, b, s), a < b, of the names in `rows` (id, name: different, not blank) that are alike by cosine `s` and not forbidden by `same`."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "grams": [grams(x) for x in b["name"]]})

    def allowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[same(x, y) for x, y in zip(b["x"], b["y"])], ["a", "b", "s"]]

    vectors = cut(spread(rows.select("id", "name")).mapInPandas(each, "id bigint, grams array<string>"))
    near = cosine_join(vectors, COSINE, top).withColumnRenamed("cosine", "s")
    named = merged(merged(near, rows.select(F.col("id").alias("a"), F.col("name").alias("x")), "a"), rows.select(F.col("id").alias("b"), F.col("name").alias("y")), "b")
    return named.select("a", "b", "s", "x", "y").mapInPandas(allowed, "a bigint, b bigint, s double")


def link_names(names: DataFrame, top: int | None = None) -> DataFrame:
    """(name, cluster, id) of the different non-blank values of the column `name`; `cluster` is the smallest id of the group.

    Ids number the names of one call and mean nothing else. Null and blank names have no row; an empty table gives none.
    """
    # two 64-bit hashes could meet; names are numbered instead
    distinct = names.select("name").where(F.col("name").isNotNull() & (F.trim("name") != "")).distinct()
    rows = cut(distinct.select(F.monotonically_increasing_id().alias("id"), "name"))
    return merged(average_linkage(rows.select("id"), similar_names(rows, top), LINKAGE), rows, "id").select("name", "cluster", "id")


def author_names(books: DataFrame) -> DataFrame:
    """(id, pos, name) of all values of `authors`."""
    return split_packed(books.select("id", "authors"), "id", ["authors"]).select("id", "pos", clean_name(F.col("item")).alias("name")).where("name <> ''")


def same_names(books: DataFrame) -> DataFrame:
    """(name_a, name_b) of different names in `authors` that mean the same, the smaller in code point order first."""
    linked = cut(link_names(author_names(books)))
    a, b = linked.select(F.col("name").alias("x"), "cluster", F.col("id").alias("i")), linked.select(F.col("name").alias("y"), "cluster", F.col("id").alias("j"))
    return merged(a, b, "cluster").where("i < j").select(F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b"))
