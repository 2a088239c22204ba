"""Full-text search over chunks: an inverted index, boolean, phrase, prefix and NEAR queries, BM25.

The index is two plain tables: postings (term, key, tf positions, length of the chunk), clustered by term so that a query
reads only the row groups of its terms, and one row of corpus statistics. A query keeps the postings of its terms, brings
those of a chunk together (the only shuffle, of matching postings alone) and evaluates the tree with array functions.
Statistics are of all chunks, before filters. Two small rows come to the driver: the corpus's and the document frequencies
with the number of matching chunks; up to `FEW` of them are broadcast to the chunks, more are merged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookspark.functions.porter import stem
from bookspark.functions.query import Near, Op, Phrase, auto_query, parse_query, phrase_query, phrases
from bookspark.functions.text import tokens
from bookspark.operators.durable import cut
from bookspark.operators.layout import wide
from bookspark.operators.store import in_section
from bookspark.sources.tables import exists, move

K1, B = 1.2, 0.75
#: Bytes of a row group of the index; the most hits that are broadcast.
ROW_GROUP, FEW = 4 << 20, 100_000
KEY = ["book_id", "position", "id"]
ORDERS = {"rank": [("score", False), ("book_id", True), ("position", True), ("id", True)], "first": [("book_id", True), ("position", True), ("id", True)], "last": [("book_id", False), ("position", False), ("id", False)]}


@dataclass
class Index:
    """Postings (book_id, position, id, term, at: array<int>, length), and statistics (n, mean_length)."""

    postings: DataFrame
    stats: DataFrame
    stemmed: bool = False

    def write(self, path: str) -> None:
        """As parquet, sorted by term within ranges of terms, in small row groups, so that the terms of a query are pushed down to few of them."""
        by_term = self.postings.repartitionByRange(wide(self.postings.sparkSession), "term", "book_id").sortWithinPartitions("term", "book_id")
        by_term.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/postings")
        self.stats.withColumn("stemmed", F.lit(self.stemmed)).write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def read(spark, path: str) -> Index:
        stats = spark.read.parquet(f"{path}/stats")
        return Index(spark.read.parquet(f"{path}/postings"), stats.select("n", "mean_length"), bool(stats.first()["stemmed"]))

    @staticmethod
    def kept(chunks: DataFrame, path: str, stemmed: bool = False) -> Index:
        """The index at `path`, written there first if it isn't: under another name, which is then changed, so no reader sees half of it.

        `path` must be of one state of `chunks`, as `sources.tables.state` names it.
        """
        spark = chunks.sparkSession
        if not exists(spark, path):
            began = f"{path}-{uuid.uuid4().hex}"
            build_index(chunks, stemmed).write(began)
            move(spark, began, path)
        return Index.read(spark, path)


def build_index(chunks: DataFrame, stemmed: bool = False) -> Index:
    """The index of `content`. A null content counts as an empty chunk. Words are stemmed once each, not in every place."""
    rows = chunks.select(*KEY, tokens("content").alias("t"))
    stats = rows.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean_length"))
    flat = rows.select(*KEY, F.size("t").alias("length"), F.posexplode("t").alias("p", "term"))
    postings = flat.groupBy(*KEY, "term", "length").agg(F.sort_array(F.collect_list("p")).alias("at"))
    if stemmed:

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"term": b["term"], "stem": [stem(t) for t in b["term"]]})

        vocabulary = postings.select("term").distinct().mapInPandas(each, "term string, stem string")
        postings = postings.join(vocabulary, "term").groupBy(*KEY, "stem", "length").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("at")).withColumnRenamed("stem", "term")
    return Index(postings.select(*KEY, "term", "at", "length"), stats, stemmed)


def _starts(p: Phrase, places: Column) -> Column:
    """Where the phrase begins, each place once; only the first place of the text if it must be initial."""
    if not p.words:
        return F.array().cast("array<int>")

    def of(i: int) -> Column:
        word, begins = p.words[i], p.prefix and i == len(p.words) - 1
        hit = F.filter(places, lambda x: x["term"].startswith(word) if begins else x["term"] == word)
        return F.array_distinct(F.flatten(F.transform(hit, lambda x: x["at"])))

    def back(a: Column, i: int) -> Column:
        return F.transform(a, lambda x: x - i)

    out = of(0)
    for i in range(1, len(p.words)):
        out = F.array_intersect(out, back(of(i), i))
    return F.filter(out, lambda x: x == 0) if p.initial else out


def _columns(tree, starts: dict[Phrase, str], counted: dict[int, Column]) -> Column:
    """Whether the tree holds, and into `counted` by place of phrase how often each phrase occurs as the tree allows."""
    here = lambda p: F.col(starts[p])
    if isinstance(tree, Phrase):
        counted[len(counted)] = F.size(here(tree))
        return F.size(here(tree)) > 0
    if isinstance(tree, Near):
        every = [(here(p), len(p.words)) for p in tree.phrases]

        def together(w: Column, n: int) -> Column:
            # a window that begins with a phrase of n words at w holds an occurrence of each
            out = F.lit(True)
            for s, _ in every:
                out = out & F.exists(s, lambda y: (y >= w) & (y <= w + n + tree.gap))
            return out

        def opening(s: Column, n: int) -> Column:
            return F.filter(s, lambda w: together(w, n))

        def covers(o: Column, n: int, x: Column) -> Column:
            return F.exists(o, lambda w: (x >= w) & (x <= w + n + tree.gap))

        opens = [(opening(s, n), n) for s, n in every]
        hit = F.lit(False)
        for s, _ in every:
            inside = F.filter(s, lambda x: _any([covers(o, n, x) for o, n in opens]))
            counted[len(counted)] = F.size(inside)
            hit = hit | (F.size(inside) > 0)
        return hit
    first = len(counted)
    left = _columns(tree.left, starts, counted)
    right = _columns(tree.right, starts, counted)
    if tree.name == "OR":
        return left | right
    holds = left & right if tree.name == "AND" else left & ~right
    for i in range(first, len(counted)):  # phrases of a part that doesn't hold don't count, though another part may
        counted[i] = F.when(holds, counted[i]).otherwise(0)
    return holds


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _stemmed(tree):
    if isinstance(tree, Phrase):
        words = tuple(w if tree.prefix and i == len(tree.words) - 1 and len(w) < 3 else stem(w) for i, w in enumerate(tree.words))
        return Phrase(words, tree.prefix, tree.initial)
    if isinstance(tree, Near):
        return Near(tuple(map(_stemmed, tree.phrases)), tree.gap)
    return Op(tree.name, _stemmed(tree.left), _stemmed(tree.right))


def _beside(few: DataFrame, n: int, other: DataFrame, on: list[str]) -> DataFrame:
    """`few`, of at most `n` rows, joined to the much larger `other`, which is shuffled only if `n` is too large to broadcast `few`."""
    return other.join(F.broadcast(few), on) if n <= FEW else few.join(other.hint("shuffle_merge"), on)


def _hits(index: Index, query: str, mode: str) -> tuple[DataFrame, int]:
    """The hits, and the number of chunks that hold any of the terms: no less than that of the hits.
    """
    if not query.strip():
        raise ValueError("the query is blank")
    tree = parse_query({"auto": auto_query, "phrase": phrase_query, "raw": str}[mode](query))
    tree = _stemmed(tree) if index.stemmed else tree
    found = list(dict.fromkeys(phrases(tree)))
    term = F.col("term")
    exact = sorted({w for p in found for i, w in enumerate(p.words) if not (p.prefix and i == len(p.words) - 1)})
    tests = ([term.isin(exact)] if exact else []) + [term.startswith(p.words[-1]) for p in found if p.prefix and p.words]
    wanted = index.postings.where(_any(tests) if tests else F.lit(False))
    # read once: the frequencies and the hits both come from what is kept
    by_chunk = wanted.groupBy(*KEY, "length").agg(F.collect_list(F.struct("term", "at")).alias("places"))
    starts = {p: f"s{i}" for i, p in enumerate(found)}
    by_chunk = cut(by_chunk.select(*KEY, "length", *[_starts(p, F.col("places")).alias(n) for p, n in starts.items()]))
    stats = index.stats.first()
    n, mean = stats["n"], stats["mean_length"] or 1.0
    df = by_chunk.agg(F.count("*").alias("chunks"), *[F.count_if(F.size(c) > 0).alias(c) for c in starts.values()]).first()
    counted: dict[int, Column] = {}
    holds = _columns(tree, starts, counted)
    score = F.lit(0.0)
    for i, p in enumerate(phrases(tree)):
        idf = F.greatest(F.lit(1e-6), F.log((F.lit(float(n)) - df[starts[p]] + 0.5) / (F.lit(float(df[starts[p]])) + 0.5)))
        tf = counted[i].cast("double")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(float(mean))))
    return by_chunk.where(holds).select(*KEY, score.alias("score")), df["chunks"]


def hits(index: Index, query: str, mode: str = "auto") -> DataFrame:
    """(book_id, position, id, score) of the chunks that match, the greater score the better.

    `mode`: auto (each word a phrase), phrase (all one phrase) or raw (the query language). Raises QuerySyntaxError, and
    ValueError if the query is blank.
    """
    return _hits(index, query, mode)[0]


def _like(column: str, value: str) -> Column:
    """LIKE '%value%' in which % and _ of the value are wildcards, letters A to Z in either case, and \\ is a plain sign."""
    small = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pattern = "".join(x.lower() if x.isascii() else x for x in value).replace("\\", "\\\\")
    return F.like(small(F.coalesce(F.col(column), F.lit(""))), F.lit(f"%{pattern}%"), F.lit("\\"))


def search(index: Index, chunks: DataFrame, books: DataFrame, query: str, mode: str = "auto", author: str = "", title: str = "", language: str = "", subject: str = "", book_ids: list[int] | None = None, kind: str | None = None, section: str = "") -> DataFrame:
    """Hits with their chunk and book. All filters are plain predicates; none changes the scores."""
    c = chunks
    if book_ids is not None:
        c = c.where(F.col("book_id").isin(book_ids) if book_ids else F.lit(False))
    if kind:
        c = c.where(F.col("kind") == kind)
    if section.strip():
        c = c.where(in_section(section))
    b = books.select(F.col("id").alias("book_id"), "title", "authors", "language", "subjects")
    for column, value in (("authors", author), ("title", title), ("language", language), ("subjects", subject)):
        if value:
            b = b.where(_like(column, value))
    found, n = _hits(index, query, mode)
    return _beside(found, n, c, KEY).join(b, "book_id")


def ordered(found: DataFrame, order: str = "rank", limit: int | None = None) -> DataFrame:
    """Hits in an order (rank, first, last), at most `limit`."""
    if order not in ORDERS:
        raise ValueError(f"unknown order: {order}")
    out = found.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in ORDERS[order]])
    return out if limit is None else out.limit(max(limit, 0))


def ranked(found: DataFrame, order: str = "rank", limit: int = 10) -> DataFrame:
    """The first `limit` hits in an order, with their `rank` from 1; these rows alone come together in one task."""
    return ordered(found, order, limit).withColumn("rank", F.row_number().over(Window.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in ORDERS[order]])))


def page(found: DataFrame, order: str = "rank", limit: int = 10) -> tuple[list, int]:
    """(rows of the page, exact total); the total is counted only if the page is full."""
    limit = max(limit, 0)
    rows = ordered(found, order, limit + 1).collect()
    return rows[:limit], found.count() if len(rows) > limit else len(rows)


def passages(found: DataFrame, chunks: DataFrame, radius: int) -> DataFrame:
    """(book_id, position, passage) of each hit: the contents within `radius` positions, joined by blank lines."""
    wanted = found.select("book_id", F.col("position").alias("hit")).distinct().select("book_id", "hit", F.explode(F.sequence(F.col("hit") - radius, F.col("hit") + radius)).alias("position"))
    wanted = cut(wanted)
    near = _beside(wanted, wanted.count(), chunks.select("book_id", "position", "id", "content"), ["book_id", "position"])
    parts = near.groupBy("book_id", "hit").agg(F.sort_array(F.collect_list(F.struct("position", "id", "content"))).alias("c"))
    return parts.select("book_id", F.col("hit").alias("position"), F.array_join(F.transform("c", lambda x: x["content"]), "\n\n").alias("passage"))

