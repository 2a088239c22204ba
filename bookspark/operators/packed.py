"""Several values packed in one field, split by the cheapest dialect.

A dialect is a set of delimiters and a quoting style. The parses of a field are scored by the length in bits of a
two-part code: the dialect, then each value. A value is coded either by its number in a dictionary of common values
(-log2 of its share of all values) or letter by letter after its form (commas, words, years ...), whichever is shorter.
The shares are counted over the whole table, first of a plain parse, then of the cheapest parses; each field is at last
parsed by its own cheapest dialect.

Every value that occurs twice is in the dictionary. Only two small tables leave the executors: the forms and the values
that make up at least 1 / 2**DICTIONARY_BITS of all values of their column, at most 2**DICTIONARY_BITS of either per column
whatever the size of the data. A rarer form costs as much as one at that bound, and a little more. The counts of rarer values stay a distributed table, which is joined to the
values of all parses of each different text, so the bound decides how a count travels and not what a value costs.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.operators.durable import cut
from bookspark.operators.layout import spread

#: The count of a value that is rarer than one in 2**15 is joined, not broadcast.
DICTIONARY_BITS = 15
ROUNDS = 2
#: Delimiters that seldom occur within values, and those that often do.
STRONG = {";": "[;；]", "|": r"\|+|[¦‖]", "•": "[•·]", "\t": "\t", "\n": r"[\r\n]+", " / ": r"(?<=\s)/(?=\s)", "/": "/"}
WEAK = {",": ",", "&": r"\s+&\s+|\s+and\s+|,\s*and\s+|,\s*&\s+", ",&": r",\s*and\s+|,\s*&\s+|\s+&\s+|\s+and\s+|,"}
#: Bits: of a letter outside the dictionary, of the end of a value, of each delimiter that a dialect names, of one that lies between words of a sentence.
LETTER, END, NAMED, LOOSE = 4.7, 1.0, 2.0, 5.0

#: Bits more of a sign that seldom belongs to a value.
STRAY = {"\n": 15, "\r": 15, "\t": 15, ";": 4, "；": 4, "|": 4, "¦": 4, "•": 4}

Dialect = tuple[tuple[str, ...], str]


def form(value: str) -> str:
    """The outline of a value: its first ten marks, each one of some twenty.

    Words become W (capital), U (capitals), w (small), I (initial); a few joining words stay, years become Y; marks that are equal in a row count once.
    """
    out = []
    for m in re.finditer(r"\d{3,4}|\d+|[^\W\d_]+\.?|\S", value):
        x = m[0]
        if x[0].isdigit():
            m = "Y" if len(x) > 2 else "d"
        elif x[0].isalpha():
            m = x if x in ("and", "of", "or") else "I" if len(x.rstrip(".")) == 1 else "U" if x.isupper() else "W" if x[0].isupper() else "w"
        else:
            m = x if x in ',-.()[]"&?;|/' else "o"
        if not (out and m == out[-1] and m in "Wwo"):
            out.append(m)
        if len(out) == 10:
            out.append("+")
            break
    return "".join(out)


def _unquote(item: str, quotes: str) -> str:
    item = item.strip()
    if quotes and len(item) > 1 and item[0] == item[-1] and item[0] in quotes[0]:
        item = item[1:-1]
        item = re.sub(r"\\(.)", r"\1", item) if "\\" in quotes else item.replace('""', '"')
    return item.strip()


@lru_cache(1000)
def _signs(names: tuple[str, ...], quotes: str) -> re.Pattern:
    """Bracketed text, quoted text, and the delimiters."""
    quoted = r'"(?:\\.|[^"\\])*"' if "\\" in quotes else r'"(?:[^"]|"")*"' if quotes else "(?!)"
    return re.compile(rf"(?P<b>\[[^\]]*\]|\([^)]*\))|(?P<q>{quoted})|(?P<d>{'|'.join(f'(?:{STRONG.get(n) or WEAK[n]})' for n in names)})")


def parse(raw: str, dialect: Dialect) -> list[str]:
    """The values of `raw` in this dialect, without blank ones. No delimiter within brackets or quotes counts."""
    names, quotes = dialect
    text = raw.strip()
    if "\\" in quotes:
        text = text[1:-1] if text[:1] == "[" and text[-1:] == "]" else text
    if not names:
        whole = _unquote(text, quotes)
        return [whole] if whole else []
    signs = _signs(names, quotes)
    items, begin, i = [], 0, 0
    while m := signs.search(text, i):
        i = m.end()
        if m["d"]:
            items.append(text[begin : m.start()])
            begin = i
        elif m["q"] and text[begin : m.start()].strip():
            i = m.start() + 1  # a quote within a value opens nothing
    items.append(text[begin:])
    return [x for x in (_unquote(x, quotes) for x in items) if x]


def dialects(raw: str) -> list[Dialect]:
    """The dialects that could have written `raw`, the plainest first."""
    text = raw.strip()
    there = [n for n, p in STRONG.items() if re.search(p, text) and not (n == "/" and not re.search(r"(?<!\s)/|/(?!\s)", text))]
    sets = [s for k in range(len(there) + 1) for s in itertools.combinations(there, k)]
    out: list[Dialect] = []
    for quotes in ["", '"'] if '"' in text else [""]:
        out += [(s, quotes) for s in sets]
        out += [((n,), quotes) for n, p in WEAK.items() if re.search(p, text)]
    if text[:1] == "[" and text[-1:] == "]":
        out.append(((",",), '"\\'))
    return out


def _plain(raw: str) -> list[str]:
    """The parse that begins the count: every strong delimiter but the bare stroke, quotes honoured."""
    text = raw.strip()
    if text[:2] == '["':
        return parse(raw, ((",",), '"\\'))
    if re.match(r'"[^"]+"\s*,\s*"', text):
        return parse(raw, ((",",), '"'))
    return parse(raw, (tuple(n for n in STRONG if n != "/"), '"'))


class Code:
    """Lengths of values in bits, from counts of values and of forms."""

    def __init__(self, values: dict[str, int], forms: dict[str, int], total: int):
        self.values, self.total = {v: -math.log2(n / total) for v, n in values.items()}, total
        every = sum(forms.values()) + len(forms) + 1
        self.forms, self.rare = {f: -math.log2(n / every) for f, n in forms.items()}, min(math.log2(every), DICTIONARY_BITS + 1.0)

    def value(self, v: str, rare: dict[str, int]) -> float:
        spelt = self.forms.get(form(v), self.rare + 4) + LETTER * len(v) + 2 + sum(STRAY.get(c, 0) for c in v)
        named = self.values.get(v) or (-math.log2(rare[v] / self.total) if v in rare else 1e9)
        return min(named + 1, spelt) + END

    def best(self, raw: str, rare: dict[str, int]) -> list[str]:
        """The values of the cheapest parse; `rare` has the counts of values of `raw` that aren't in `values`."""
        least, out = 1e18, []
        for names, quotes in dialects(raw):
            items = parse(raw, (names, quotes))
            cost = NAMED * len(names) + LOOSE * (names[:1] != () and names[0] in WEAK) + NAMED * bool(quotes) + sum(self.value(v, rare) for v in items)
            if cost < least - 1e-9:
                least, out = cost, items
        return out

    def unknown(self, raw: str) -> set[str]:
        """The values of all parses of `raw` that aren't in `values`; none if there is only one parse."""
        of = dialects(raw)
        return {v for d in of for v in parse(raw, d) if v not in self.values} if len(of) > 1 else set()


def _tuples(items, counts) -> tuple[tuple[str, ...], tuple[int, ...]]:
    return ((), ()) if items is None else (tuple(items), tuple(counts))


def _counts(items, counts) -> dict[str, int]:
    return {} if items is None else dict(zip(items, counts))


def split_packed(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row (`key`, field, pos, item) for each value in each of `fields`; `pos` counts from 1 in each field.

    Null, empty and blank fields have no row, nor have empty places within a list. Repeated rows come out repeated, and
    extra columns of `df` don't matter, whatever their names. An empty table gives an empty one.
    """
    spark = df.sparkSession
    raw = df.select(F.col(key).alias("key"), F.posexplode(F.array(*[F.col(f) for f in fields])).alias("at", "raw"))
    raw = raw.where(F.col("raw").isNotNull() & (F.trim("raw") != "")).select("key", F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("at") + 1).alias("field"), "raw")

    # each different text is parsed once, however often it occurs
    texts = raw.groupBy("field", "raw").agg(F.count("*").alias("n")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    nothing = [F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<bigint>").alias("counts")]

    def known(code: dict[str, Code], rare: DataFrame | None) -> DataFrame | None:
        """(field, raw, items, counts) of the texts that have rare values in some parse."""
        if rare is None:
            return None

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([(i, f, v) for i, f, t in zip(b["id"], b["field"], b["raw"]) for v in code[f].unknown(t)], columns=["id", "field", "item"])

        numbered = cut(texts.select(F.monotonically_increasing_id().alias("id"), "field", "raw"))
        met = numbered.mapInPandas(each, "id bigint, field string, item string").join(rare.hint("shuffle_merge"), ["field", "item"])
        met = met.groupBy("id").agg(F.collect_list(F.struct("item", "n")).alias("met"))
        return numbered.join(met.hint("shuffle_merge"), "id").select("field", "raw", F.col("met.item").alias("items"), F.col("met.n").alias("counts"))

    def with_known(df: DataFrame, known: DataFrame | None) -> DataFrame:
        return df.select("*", *nothing) if known is None else df.join(known.hint("shuffle_merge"), ["field", "raw"], "left")

    def counts(code: dict[str, Code] | None, rare: DataFrame | None) -> tuple[dict[str, Code], DataFrame | None]:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                seen: Counter = Counter()
                for field, text, n, vs, ns in zip(b["field"], b["raw"], b["n"], b["items"], b["counts"]):
                    for v in code[field].best(text, _counts(vs, ns)) if code and field in code else _plain(text):
                        seen[field, v] += n
                yield pd.DataFrame([(f, v, form(v), n) for (f, v), n in seen.items()], columns=["field", "item", "form", "n"])

        parsed = with_known(texts, known(code, rare) if code else None).select("field", "raw", "n", "items", "counts")
        items = cut(parsed.mapInPandas(each, "field string, item string, form string, n bigint").groupBy("field", "item", "form").agg(F.sum("n").alias("n")))
        totals = {r["field"]: r["n"] for r in items.groupBy("field").agg(F.sum("n").alias("n")).collect()}
        forms: dict[str, dict[str, int]] = {f: {} for f in totals}
        values: dict[str, dict[str, int]] = {f: {} for f in totals}
        bounds = {f: max(2, n >> DICTIONARY_BITS) for f, n in totals.items()}
        least = F.coalesce(*[F.when(F.col("field") == f, F.lit(n)) for f, n in bounds.items()], F.lit(2))
        for r in items.groupBy("field", "form").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect():
            forms[r["field"]][r["form"]] = r["n"]
        for r in items.where(F.col("n") >= least).collect():
            values[r["field"]][r["item"]] = r["n"]
        # below the bound and seen twice: only in tables so large that the bound is above two
        rest = items.where((F.col("n") > 1) & (F.col("n") < least)).select("field", "item", "n") if max(bounds.values(), default=2) > 2 else None
        return {f: Code(values[f], forms[f], n) for f, n in totals.items()}, rest

    code: dict[str, Code] | None = None
    rare: DataFrame | None = None
    for _ in range(ROUNDS):
        code, rare = counts(code, rare)
    sent = spark.sparkContext.broadcast(code)

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = lru_cache(20_000)(lambda field, text, vs, ns: sent.value[field].best(text, dict(zip(vs, ns))))
        for b in batches:
            found = ((k, f, best(f, t, *_tuples(vs, ns))) for k, f, t, vs, ns in zip(b["key"], b["field"], b["raw"], b["items"], b["counts"]))
            yield pd.DataFrame([(k, f, i, v) for k, f, vs in found for i, v in enumerate(vs, 1)], columns=[key, "field", "pos", "item"])

    last = with_known(raw, known(code, rare)).select("key", "field", "raw", "items", "counts")
    kind = df.schema[key].dataType.simpleString()
    return spread(last).mapInPandas(final, f"`{key}` {kind}, field string, pos int, item string")
