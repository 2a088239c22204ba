"""The commands of a library, composed of the operators; each gives its answer as a JSON envelope.

Only what is shown comes to the driver: a page of hits, the sections of one book, the rows of one reading window.
Wrong arguments and malformed queries give an envelope with `ok` false and the errors, never an exception.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.functions.query import QuerySyntaxError, auto_query, phrase_query
from bookspark.functions.text import book_link, expand_depth, section_path, single_line
from bookspark.operators import catalog as C
from bookspark.operators import fulltext as T
from bookspark.operators import sections as S
from bookspark.operators import store as R
from bookspark.operators.ingest import ingest, plan_ingest
from bookspark.plans.payload import book_payloads, envelope, passage_payloads, search_filters, section_payloads


class CommandError(ValueError):
    """An error with what there is to say of the request."""

    def __init__(self, text: str, data: dict | None = None):
        super().__init__(text)
        self.data = data


def _command(f: Callable[..., tuple[dict, list[str]]]) -> Callable[..., str]:
    name = f.__name__

    @wraps(f)
    def run(*args, **kwargs) -> str:
        try:
            data, warnings = f(*args, **kwargs)
        except CommandError as x:
            return envelope(name, x.data, errors=[str(x)])
        except ValueError as x:
            return envelope(name, errors=[str(x)])
        return envelope(name, data, warnings)

    return run


def _positive(**numbers: int | None) -> None:
    for what, n in numbers.items():
        if n is not None and n <= 0:
            raise CommandError(f"{what} must be above 0")


def _payloads(rows: DataFrame) -> list[dict]:
    return [json.loads(r["payload"]) for r in rows.collect()]


@dataclass
class Library:
    """What is stored, the search index, and the address below which books have their pages."""

    books: DataFrame
    texts: DataFrame
    chunks: DataFrame
    index: T.Index | None = None
    base: str = "https://books.example/ebooks"

    def has(self, book_id: int) -> bool:
        return not self.texts.where(F.col("book_id") == book_id).isEmpty()


@_command
def catalog(records: DataFrame, base: str, author: str = "", title: str = "", language: str = "", subject: str = "", limit: int = 20):
    """The first records that match, with the number of all that do."""
    _positive(limit=limit)
    found = C.search_catalog(records, author, title, language, subject)
    total = found.count()
    items = _payloads(book_payloads(found.limit(limit), base).orderBy("id"))
    return {"filters": {"author": author, "title": title, "language": language, "subject": subject}, "limit": limit, "total_matches": total, "shown": len(items), "remaining": total - len(items), "items": items}, []


@_command
def search(lib: Library, query: str, mode: str = "auto", author: str = "", title: str = "", language: str = "", subject: str = "", book_ids: list[int] | None = None, kind: str | None = None, section: str = "", order: str = "rank", limit: int = 10, radius: int | None = None, count: bool = False):
    """A page of passages, or with `count` the number of hits alone. `section`: a path, or a section's number if there is one book."""
    _positive(limit=limit)
    if radius is not None and (radius < 0 or count):
        raise CommandError("radius must be 0 or more, and goes with no count")
    if order not in T.ORDERS:
        raise CommandError(f"unknown order: {order}")
    if mode not in ("auto", "phrase", "raw"):
        raise CommandError(f"unknown mode: {mode}")
    given = search_filters(author, title, language, subject, book_ids, kind, section)
    asked = {"raw": query, "fts": {"auto": auto_query, "phrase": phrase_query, "raw": str}[mode](query), "mode": mode}
    warnings = [f"Book {i} is not in the database." for i in book_ids or [] if not lib.has(i)]
    if section.isdigit():
        if len(book_ids or []) != 1:
            raise CommandError("a section's number needs exactly one book")
        section = S.section_path_of(S.section_rows(lib.chunks.where(F.col("book_id") == book_ids[0])), book_ids[0], int(section))
    R.path_segments(section)
    try:
        found = T.search(lib.index, lib.chunks, lib.books, query, mode, author, title, language, subject, book_ids or None, kind, section)
    except QuerySyntaxError as x:
        raise CommandError(f"Invalid query syntax: {x}.", {"query": asked, "filters": given, "order": order, "limit": limit} | ({} if radius is None else {"radius": radius})) from x
    total = found.count()
    if count:
        return {"query": asked, "filters": given, "count": total}, warnings
    path = section_path(*S.DIVS)
    shown = T.ranked(found, order, limit).withColumn("section", F.when(path == "", F.lit("(unsectioned opening)")).otherwise(path))
    ids = [r["book_id"] for r in shown.select("book_id").distinct().collect()]
    numbers = S.section_numbers(S.section_rows(lib.chunks.where(F.col("book_id").isin(ids) if ids else F.lit(False))))
    shown = shown.join(numbers, ["book_id", "section"], "left")
    if radius is not None:
        shown = shown.drop("content").join(T.passages(shown, lib.chunks, radius).withColumnRenamed("passage", "content"), ["book_id", "position"])
    rows = shown.select("rank", "kind", F.round("score", 4).alias("score"), "book_id", single_line(F.coalesce("title", F.lit(""))).alias("title"), single_line(F.coalesce("authors", F.lit(""))).alias("author"), "section", "section_number", "position", F.lit(radius).cast("int").alias("radius"), book_link("book_id", lib.base).alias("link"), "content", F.lit(None).cast("int").alias("forward"), F.lit(None).cast("boolean").alias("all"))
    items = [r.asDict() for r in rows.orderBy("rank").collect()]
    return {"query": asked, "filters": given, "order": order, "limit": limit, "total_results": total, "shown_results": len(items), "items": items}, warnings


@_command
def toc(lib: Library, book_id: int, expand: str = "2"):
    """A book's overview and its sections down to a depth."""
    depth = expand_depth(expand)
    chunks = lib.chunks.where(F.col("book_id") == book_id)
    whole = S.overview(chunks).first()
    if whole is None:
        raise CommandError(f"Book {book_id} is not in the database.")
    sections = S.rolled_up(S.section_rows(chunks), depth)
    word = S.search_words(chunks).first()["word"]
    rows = section_payloads(sections).first()
    return {"book": _payloads(book_payloads(R.book(lib.books, book_id), lib.base)), "overview": whole.asDict(), "expand": expand, "sections": json.loads(rows["payload"]) if rows else [], "try": word}, []


@_command
def view(lib: Library, book_id: int, position: int | None = None, section: str = "", forward: int | None = None, radius: int | None = None, all: bool = False):  # noqa: A002
    """Passages of a book: from a position, of a section (path or number), of its opening, or all of it."""
    if sum((forward is not None, radius is not None, all)) > 1 or position is not None and section:
        raise CommandError("only one of forward, radius and all, and only one of position and section, can be given")
    _positive(forward=forward)
    if radius is not None and (radius < 0 or position is None):
        raise CommandError("radius is 0 or more and goes with a position")
    chunks = lib.chunks.where(F.col("book_id") == book_id)
    if chunks.isEmpty():
        raise CommandError(f"Book {book_id} is not in the database.")
    number = None
    if section:
        number = int(section) if section.isdigit() else None
        path = S.section_path_of(S.section_rows(chunks), book_id, number) if number is not None else section
        inside = R.chunks_by_div(chunks, path)
        start = inside.agg(F.min("position").alias("p")).first()["p"]
        if start is None:
            raise CommandError(f"Section {section!r} is not in book {book_id}.")
        rows = inside if all else S.reading_window(chunks, inside.sparkSession.createDataFrame([(book_id, start)], "book_id bigint, start int"), forward or 1)
    elif position is not None:
        if R.chunk_by_position(chunks, book_id, position).isEmpty():
            raise CommandError(f"Position {position} is not in book {book_id}.")
        near = F.col("position").between(position - radius, position + radius) if radius is not None else F.col("position") >= position if all else F.col("position") == position
        rows = chunks.where(near) if forward is None else S.forward(chunks, chunks.sparkSession.createDataFrame([(book_id, position)], "book_id bigint, start int"), forward)
    else:
        rows = chunks if all else S.opening_window(chunks, lib.books, forward or 3)
    shown = rows.select("position", "id", "content", section_path(*S.DIVS).alias("section"), "kind", "char_count").orderBy("position", "id").collect()
    record = R.book(lib.books, book_id).first()
    passage = lib.books.sparkSession.createDataFrame(
        [(book_id, (record["title"] if record else "") or "", (record["authors"] if record else "") or "", shown[0]["section"] or None, number, shown[0]["position"], forward, radius, all or None, "\n\n".join(r["content"] for r in shown if r["content"] is not None))],
        "book_id bigint, title string, author string, section string, section_number int, position int, forward int, radius int, all boolean, content string",
    )
    text = [r for r in shown if r["kind"] == "text"]
    return _payloads(passage_payloads(passage, lib.base))[0] | {"paragraphs": len(text), "chars": sum(r["char_count"] or 0 for r in text)}, []


@_command
def books(lib: Library, version: int, refresh: list[int] | None = None, force: bool = False):
    """The stored books, or with `refresh` what reading these ids again would do: given ids are always read again."""
    if refresh is None:
        return {"items": _payloads(book_payloads(lib.books.orderBy("id"), lib.base))}, []
    wanted = lib.books if not refresh else lib.books.where(F.col("id").isin(refresh))
    there = {r["id"] for r in wanted.select("id").collect()} if refresh else set()
    plan = plan_ingest(wanted, lib.texts, force or bool(refresh), version)
    return {"actions": {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}}, [f"Book {i} is not in the database." for i in refresh if i not in there]


@_command
def add(store: R.Store, records: DataFrame, pages: DataFrame, ids: list[int], policy: C.Policy | None = None, order: str | None = None, force: bool = False):
    """Reads the works of the requested ids into the store: the policy, one record a work, then ingest; what became of each id."""
    kept, links = C.catalog(records, policy, order)
    spark = records.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), "request_pos int, id bigint")
    asked = C.requests(wanted, links)
    chosen = kept.join(asked.where("status = 'requested'").select(F.col("canonical_id").alias("id")), "id", "left_semi")
    report = {r["id"]: r["status"] for r in ingest(store, chosen, pages, force).collect()}
    rows = [(r["id"], r["canonical_id"], {"missing": "out_of_policy", "duplicate_requested": "duplicate_requested"}.get(r["status"]) or report.get(r["canonical_id"], "failed")) for r in asked.orderBy("request_pos").collect()]
    counts: dict[str, int] = {}
    for _, _, status in rows:
        counts[status] = counts.get(status, 0) + 1
    data = {"items": [{"id": i, "canonical_id": c, "status": s} for i, c, s in rows], "counts": counts}
    if not counts.keys() - {"failed", "out_of_policy"}:
        raise CommandError("no book was added", data)
    return data, [f"Book {i}: {s}." for i, _, s in rows if s in ("failed", "out_of_policy")]


@_command
def remove(store: R.Store, ids: list[int]):
    """Takes books out of the store; ids that aren't there are errors, after the others are gone."""
    had = store.read("books")
    there = {r["id"] for r in had.where(F.col("id").isin(ids)).select("id").collect()} if had is not None else set()
    if there:
        store.remove(had.sparkSession.createDataFrame([(i,) for i in sorted(there)], "id bigint"))
    if missing := [i for i in ids if i not in there]:
        raise CommandError("; ".join(f"Book {i} is not in the database." for i in missing), {"removed": sorted(there)})
    return {"removed": sorted(there)}, []
