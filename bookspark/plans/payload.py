"""Answers of the commands as JSON: one envelope, with books, passages and summaries inside."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.functions.text import book_link, preview, single_line


def envelope(command: str, data=None, warnings: list[str] | None = None, errors: list[str] | None = None) -> str:
    """ok is false if there are errors."""
    return json.dumps({"ok": not errors, "command": command, "data": data, "warnings": warnings or [], "errors": errors or []}, ensure_ascii=False)


def search_filters(author: str = "", title: str = "", language: str = "", subject: str = "", book_ids: list[int] | None = None, kind: str | None = None, section: str = "") -> dict:
    """The filters of a search as they were given; one book id stands alone, several in a list."""
    ids = None if not book_ids else book_ids[0] if len(book_ids) == 1 else list(book_ids)
    return {"author": author or None, "title": title or None, "language": language or None, "subject": subject or None, "book_id": ids, "kind": kind or "all", "section": section or None}


# The fields of a book and of a passage.
BOOK_FIELDS = ["title", "authors", "language", "subjects", "locc", "bookshelves", "issued", "type"]
PASSAGE_FIELDS = ["book_id", "title", "author", "section", "section_number", "position", "forward", "radius", "all", "link", "content"]
WHOLE = {"ignoreNullFields": "false"}


def book_payloads(books: DataFrame, base: str) -> DataFrame:
    """(id, payload) of books: every field in one line, and the page of the book below `base`."""
    fields = [single_line(F.coalesce(c, F.lit(""))).alias(c) for c in BOOK_FIELDS]
    return books.select("id", F.to_json(F.struct("id", *fields, book_link("id", base).alias("link")), WHOLE).alias("payload"))


def passage_payloads(passages: DataFrame, base: str) -> DataFrame:
    """(book_id, position, payload) of rows with `book_id`, `content` and any other of PASSAGE_FIELDS; missing ones are null."""
    given = {c: F.col(c) if c in passages.columns else F.lit(None).cast("string") for c in PASSAGE_FIELDS if c != "link"} | {"link": book_link("book_id", base)}
    return passages.select("book_id", given["position"].alias("position"), F.to_json(F.struct(*[given[c].alias(c) for c in PASSAGE_FIELDS]), WHOLE).alias("payload"))


def section_payloads(sections: DataFrame) -> DataFrame:
    """(book_id, payload): the sections of each book in order, opening lines cut to 140 signs. A book's headings only, not its text, come together."""
    row = F.struct("section_number", "section", "paras", "chars", "est_words", "est_read", preview("opening_line", 140).alias("opening_line"))
    return sections.groupBy("book_id").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("payload"))


def parse_book_ids(text: str) -> list[int]:
    """Book ids between spaces; raises ValueError."""
    ids = [int(x) for x in text.split()]
    if not ids or any(i <= 0 for i in ids):
        raise ValueError("book ids are positive whole numbers")
    return ids
