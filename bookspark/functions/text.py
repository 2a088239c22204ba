"""Scalar functions as Columns. All stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paragraphs looked at for an opening line.
OPENING_CANDIDATES = 4
# Words that may stay small in a title, signs that end a sentence, words that make no search.
CONNECTORS = "a an and as at by for from in of on or the to with".split()
STOPWORDS = "about after before being call could first from have having however into little never ought shall should since some there these those through under until upon when where which while would years".split()
#: Shown for nothing and for zero.
NOTHING = "-"


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def single_line(c) -> Column:
    """Each run of white space one space, trimmed."""
    return F.trim(F.regexp_replace(_column(c), r"(?U)\s+", " "))


def preview(c, n: int) -> Column:
    """At most n signs, line feeds as spaces; an ellipsis marks what is left out."""
    flat = F.translate(_column(c), "\n", " ")
    return F.when(F.length(flat) > n, F.concat(F.left(flat, F.lit(n)), F.lit("…"))).otherwise(flat)


def split_list(c) -> Column:
    """The non-blank items of a list with semicolons, each in one line."""
    return F.filter(F.transform(F.split(F.coalesce(_column(c), F.lit("")), ";"), lambda x: single_line(x)), lambda x: x != "")


def summarize_list(c, n: int) -> Column:
    """The first n items, then how many more there are."""
    items = split_list(c)
    more = F.size(items) - n
    return F.concat(F.array_join(F.slice(items, 1, n), "; "), F.when(more > 0, F.concat(F.lit("; +"), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def straight_apostrophes(c) -> Column:
    return F.translate(_column(c), "‘’", "''")


def indent_block(c, prefix: str) -> Column:
    """`prefix` before every line that isn't empty."""
    return F.regexp_replace(_column(c), r"(?m)^(?=.)", prefix)


def work_text(c) -> Column:
    """Small letters and digits, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_column(c), F.lit(""))), r"[^a-z0-9]+", " "))


def primary_author(c) -> Column:
    """What stands before the first semicolon, without roles in brackets at its end."""
    first = F.element_at(F.split(F.coalesce(_column(c), F.lit("")), ";", 2), 1)
    return F.trim(F.regexp_replace(first, r"(\s*(\[[^\]]+\]|\([^)]+\)))+\s*$", ""))


def section_parts(*divs) -> Column:
    """The non-blank divisions in order."""
    return F.filter(F.array(*[F.coalesce(_column(d), F.lit("")) for d in divs]), lambda x: F.trim(x) != "")


def section_path(*divs) -> Column:
    return F.array_join(section_parts(*divs), " / ")


def est_words(chars) -> Column:
    return F.round(_column(chars) / 5).cast("bigint")


def read_time(words) -> Column:
    """Minutes at 250 words, at least one; hours from sixty on."""
    w = _column(words)
    m = F.greatest(F.bround(w / 250).cast("bigint"), F.lit(1))
    hours = F.floor(m / 60)
    return F.when(w <= 0, "n/a").when(m >= 60, F.concat(hours.cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m"))).otherwise(F.concat(m.cast("string"), F.lit("m")))


def normal_segment(c) -> Column:
    """One part of a section path as it is compared: one line, small letters, no space around punctuation, none at the end."""
    x = F.lower(single_line(c))
    x = F.regexp_replace(x, r"\s*([.,;:!?])\s*", "$1")
    return F.trim(F.regexp_replace(x, r"[\s.,;:!?\"'’”)\]}»]+$", ""))


def thousands(c) -> Column:
    return F.format_number(_column(c).cast("bigint"), 0)


def plural(n, word: str) -> Column:
    return F.concat(thousands(n), F.lit(f" {word}"), F.when(_column(n) == 1, "").otherwise("s"))


def book_link(book_id, base: str) -> Column:
    return F.concat(F.lit(f"{base.rstrip('/')}/"), _column(book_id).cast("string"))


def title_like(c) -> Column:
    """A line of one to eight words as titles have them, that ends no sentence and has no comma or semicolon.

    Each word, without signs at its ends, is a roman numeral, in capitals, capitalised and else small, or a joining word.
    """
    flat = single_line(c)
    words = F.filter(F.transform(F.split(flat, " "), lambda w: F.regexp_replace(w, r"""^[()\[\]{}"'“”‘’,;:\-]+|[()\[\]{}"'“”‘’,;:\-]+$""", "")), lambda w: w != "")

    def fits(w: Column) -> Column:
        plain = w.rlike(r"^[A-Za-z]+(?:['’][A-Za-z]+)*$")
        return w.rlike(r"^(?i)[ivxlcdm]+$") | (w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}")) | (plain & (F.lower(w).isin(CONNECTORS) | w.rlike(r"^[A-Z][^A-Z]*$")))

    return (F.size(words) >= 1) & (F.size(words) <= 8) & ~flat.rlike(r"""[.!?]["')\]]*$|[,;]""") & F.forall(words, fits)


def opening_line(paragraphs) -> Column:
    """Of the first paragraphs (an array in order, blank ones left out): the first that is no title, if titles lead up to it, else the first."""
    p = F.slice(F.filter(F.transform(_column(paragraphs), lambda x: single_line(x)), lambda x: x != ""), 1, OPENING_CANDIDATES)
    titles = F.transform(p, lambda x: title_like(x))
    body = F.array_position(titles, False)
    return F.when((body > 2) | ((body == 2) & F.element_at(p, 1).endswith(":")), F.try_element_at(p, body.cast("int"))).otherwise(F.coalesce(F.try_element_at(p, F.lit(1)), F.lit("")))


def words_to_search(c) -> Column:
    """(good, first): the first word of four letters or more that isn't too common, and the first word at all; null if there is none."""
    words = F.regexp_extract_all(F.coalesce(_column(c), F.lit("")), F.lit(r"([A-Za-z]+(?:['’][A-Za-z]+)*)"), 1)
    good = F.filter(words, lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(STOPWORDS))
    return F.struct(F.try_element_at(good, F.lit(1)).alias("good"), F.try_element_at(words, F.lit(1)).alias("first"))


def dash_for_nothing(n) -> Column:
    """A number with commas; a dash for null, zero and less."""
    return F.when(_column(n) > 0, thousands(n)).otherwise(F.lit(NOTHING))


def work_key(title, authors) -> Column:
    """(title, author) by which works are told apart; null if either is empty."""
    t, a = work_text(title), work_text(primary_author(authors))
    return F.when((t != "") & (a != ""), F.struct(t.alias("title"), a.alias("author")))


def toc_label(section) -> Column:
    """The last part of a section path, indented by its depth."""
    parts = F.split(_column(section), " / ")
    return F.concat(F.repeat(F.lit("  "), F.size(parts) - 1), F.element_at(parts, -1))


def expand_depth(expand: str) -> int:
    """The number of levels that "1" to "4" or "all" stand for; raises ValueError for others."""
    if expand not in ("1", "2", "3", "4", "all"):
        raise ValueError(f"levels are 1 to 4 or all, not {expand!r}")
    return 4 if expand == "all" else int(expand)


def _unaccented() -> tuple[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks that are a plain letter with marks, and these letters."""
    pairs = []
    for i in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        flat = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if len(flat) == 1 and flat != chr(i) and flat.isalpha():
            pairs.append((chr(i), flat))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _unaccented()


def tokens(c) -> Column:
    """Words in small letters without diacritics: runs of letters, digits and private signs."""
    flat = F.translate(F.regexp_replace(F.lower(F.coalesce(_column(c), F.lit(""))), r"\p{M}+", ""), _FROM, _TO)
    return F.filter(F.split(flat, r"[^\p{L}\p{N}\p{Co}]+"), lambda x: x != "")
