"""Sections of books: numbers, statistics, roll-up to a depth, reading windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.functions.text import OPENING_CANDIDATES, est_words, opening_line, read_time, section_path, single_line, words_to_search
from bookspark.operators.durable import cut
from bookspark.operators.scan import running_max, running_sum

DIVS = ["div1", "div2", "div3", "div4"]
# Headings of front matter.
FRONT_MATTER = ["contents", "table of contents", "list of illustrations", "illustrations", "index", "title page", "copyright", "transcriber's note", "transcriber's notes", "notes", "dedication", "frontispiece"]


def with_section_numbers(chunks: DataFrame) -> DataFrame:
    """`chunks` with section_number: headings of the book so far; 0 before the first."""
    return running_sum(chunks, "book_id", "position", F.col("kind") == "heading", "section_number", tie="id")


def section_rows(chunks: DataFrame) -> DataFrame:
    """(book_id, section_number, section, position, depth, paras, chars, est_words, est_read, opening_line), a row for each heading.

    Paragraphs up to the next heading belong to it; those before the first to none. A heading without divisions is
    labelled by its own text.
    """
    rows = with_section_numbers(chunks.select("book_id", "id", "position", "kind", "content", "char_count", *DIVS)).where("section_number > 0")
    path = section_path(*DIVS)
    own = single_line(F.coalesce("content", F.lit("")))
    label = F.when(path != "", path).when(own != "", own).otherwise(F.lit("(untitled section)"))
    text, key = F.col("kind") == "text", ["book_id", "section_number"]
    stats = rows.groupBy(*key).agg(
        F.max(F.when(F.col("kind") == "heading", F.struct(label.alias("section"), F.col("position").cast("bigint").alias("position"), F.greatest(F.size(F.split(label, " / ")), F.lit(1)).alias("depth")))).alias("h"),
        F.count_if(text).alias("paras"),
        F.coalesce(F.sum(F.when(text, F.col("char_count"))), F.lit(0)).cast("bigint").alias("chars"),
    )
    # the first paragraphs by a running count, not by gathering the section
    filled = rows.where(text & (own != "")).select(*key, "position", "id", own.alias("line"))
    counted = running_sum(filled, "book_id", "position", F.lit(1), "n", tie="id")
    first = counted.groupBy(*key).agg(F.min("n").alias("n0"))
    lines = counted.join(first, key).where(F.col("n") < F.col("n0") + OPENING_CANDIDATES).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l"))
    opening = lines.select(*key, opening_line(F.transform("l", lambda x: x["line"])).alias("opening_line"))
    words = est_words("chars")
    return stats.join(opening, key, "left").select(*key, "h.section", "h.position", "h.depth", "paras", "chars", words.alias("est_words"), read_time(words).alias("est_read"), F.coalesce("opening_line", F.lit("")).alias("opening_line"))


def overview(chunks: DataFrame) -> DataFrame:
    """One row a book: counts by kind, characters of all kinds, depth, words and reading time."""
    path = section_path(*DIVS)
    out = chunks.groupBy("book_id").agg(
        F.count("*").alias("chunks_total"),
        F.count_if(F.col("kind") == "heading").alias("sections_total"),
        F.count_if(F.col("kind") == "text").alias("paragraphs_total"),
        F.coalesce(F.sum("char_count"), F.lit(0)).cast("bigint").alias("chars_total"),
        F.max(F.when(path == "", 0).otherwise(F.size(F.split(path, " / ")))).cast("bigint").alias("levels_total"),
    )
    words = est_words("chars_total")
    return out.select("*", words.alias("est_words"), read_time(words).alias("est_read"))


def rolled_up(sections: DataFrame, depth: int) -> DataFrame:
    """Sections down to `depth`; deeper ones add to the nearest section before them that is shown and whose path begins theirs, else vanish.

    Depth 4 and more leaves all as they are.
    """
    if depth >= 4:
        return sections
    parts = F.split("section", " / ")
    # kept, as each depth reads them twice
    rows = cut(sections).withColumn("parts", parts)
    for k in range(1, depth + 1):
        rows = rows.withColumn(f"p{k}", F.array_join(F.slice("parts", 1, k), " / "))
        rows = running_max(rows, ["book_id", f"p{k}"], "section_number", F.when(F.col("depth") == k, F.col("section_number")), f"o{k}")
    owner = F.when(F.col("depth") <= depth, F.col("section_number")).otherwise(F.greatest(*[F.col(f"o{k}") for k in range(1, depth + 1)]) if depth > 1 else F.col("o1") if depth else F.lit(None))
    owned = rows.withColumn("owner", owner).where("owner is not null")
    own = F.col("owner") == F.col("section_number")
    first = F.struct(F.when(own, 0).otherwise(1).alias("later"), "section_number")
    sums = owned.groupBy("book_id", F.col("owner").alias("section_number")).agg(
        F.max(F.when(own, F.struct("section", "position", "depth"))).alias("h"),
        F.sum("paras").alias("paras"),
        F.sum("chars").alias("chars"),
        F.coalesce(F.min_by(F.col("opening_line"), F.when(F.col("opening_line") != "", first)), F.lit("")).alias("opening_line"),
    )
    words = est_words("chars")
    return sums.select("book_id", "section_number", "h.section", "h.position", "h.depth", "paras", "chars", words.alias("est_words"), read_time(words).alias("est_read"), "opening_line")


def section_numbers(sections: DataFrame) -> DataFrame:
    """(book_id, section, section_number): of sections with one path, the last."""
    return sections.groupBy("book_id", "section").agg(F.max("section_number").alias("section_number"))


def section_path_of(sections: DataFrame, book_id: int, number: int) -> str:
    """The path of a book's section by its number; raises ValueError for numbers that the book hasn't."""
    of = sections.where(F.col("book_id") == book_id)
    found = of.where(F.col("section_number") == number).select("section").first()
    if found is None:
        n = of.count()
        raise ValueError(f"section {number} is out of range (book {book_id} has {n} sections)" if n else f"book {book_id} has no sections")
    return found["section"]


def search_words(chunks: DataFrame) -> DataFrame:
    """(book_id, word): a word of each book's text to try a search with: the first uncommon one, else the first, else "chapter"."""
    order = F.struct("position", "id")
    rows = chunks.where("kind = 'text'").select("book_id", order.alias("o"), words_to_search("content").alias("w"))
    found = rows.groupBy("book_id").agg(F.min_by("w.good", F.when(F.col("w.good").isNotNull(), F.col("o"))).alias("good"), F.min_by("w.first", F.when(F.col("w.first").isNotNull(), F.col("o"))).alias("first"))
    books = chunks.select("book_id").distinct()
    return books.join(found, "book_id", "left").select("book_id", F.coalesce("good", "first", F.lit("chapter")).alias("word"))


def with_visible_number(sections: DataFrame, depth: int) -> DataFrame:
    """(book_id, section_number, visible_number): the deepest section shown that begins the path of each, ties to the first."""
    rows = sections.withColumn("parts", F.split("section", " / "))
    shown = sections.where(F.col("depth") <= depth).groupBy("book_id", "section").agg(F.min("section_number").alias("visible_number"))
    prefix = rows.select("book_id", "section_number", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(max(depth, 1)))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("parts", 1, k), " / ").alias("section")))).alias("x")).select("book_id", "section_number", "x.*")
    return prefix.join(shown, ["book_id", "section"]).groupBy("book_id", "section_number").agg(F.max_by("visible_number", "k").alias("visible_number"))


def forward(chunks: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """The first n chunks of each book from the position of `starts` (book_id, start) on."""
    rows = chunks.join(starts, "book_id").where(F.col("position") >= F.col("start"))
    ranked = running_sum(rows, "book_id", "position", F.lit(1), "rank", tie="id")
    return ranked.where(F.col("rank") <= n).drop("start", "rank")


def reading_window(chunks: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """From `starts` (book_id, start) on, chunks until n paragraphs are read; headings between them come along, across sections."""
    rows = chunks.join(starts, "book_id").where(F.col("position") >= F.col("start"))
    text = F.col("kind") == "text"
    read = running_sum(rows, "book_id", "position", text, "read", tie="id")
    return read.where(F.col("read") - text.cast("int") < n).drop("start", "read")


def opening_window(chunks: DataFrame, books: DataFrame, n: int) -> DataFrame:
    """The first n chunks of each book from its first real heading: no front matter, title or author; further headings are passed until a paragraph comes."""
    flat = F.lower(single_line(F.coalesce("content", F.lit(""))))
    title = F.lower(single_line(F.coalesce("title", F.lit(""))))
    repeats = (F.length(flat) >= 3) & (title.startswith(flat) | ((F.length(title) >= 3) & flat.startswith(title)))
    skip = flat.isin(FRONT_MATTER) | flat.startswith("by ") | repeats
    heads = chunks.where("kind = 'heading'").join(books.select(F.col("id").alias("book_id"), "title"), "book_id", "left").where(~skip)
    start = heads.groupBy("book_id").agg(F.min("position").alias("start"))
    every = chunks.select("book_id").distinct().join(start, "book_id", "left").select("book_id", F.coalesce("start", F.lit(0)).alias("start"))
    rows = chunks.join(every, "book_id").where(F.col("position") >= F.col("start"))
    body = rows.where("kind <> 'heading'").groupBy("book_id").agg(F.min("position").alias("body"))
    ranked = running_sum(rows, "book_id", "position", F.lit(1), "rank", tie="id").join(body, "book_id", "left")
    # n rows, or on to the first paragraph if these are all headings
    return ranked.where((F.col("rank") <= n) | (F.col("position") <= F.col("body"))).drop("start", "rank", "body")
