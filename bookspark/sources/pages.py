"""Pages of books: addresses, archives, and the first source that answers."""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds that a stored catalogue counts as fresh.
CATALOG_TTL = 2 * 60 * 60
USER_AGENT = "bookspark/0.1"


@dataclass(frozen=True)
class Source:
    """A place of pages; `pattern` has {id}. Sources are tried in the order of `priority`."""

    name: str
    pattern: str
    priority: int

    def url(self, book_id: Column) -> Column:
        before, _, after = self.pattern.partition("{id}")
        rest = after.split("{id}")
        return reduce(lambda c, part: F.concat(c, book_id.cast("string"), F.lit(part)), rest, F.lit(before))


def candidates(ids: DataFrame, sources: list[Source]) -> DataFrame:
    """(id, source, priority, url) of every id at every source."""
    each = F.array(*[F.struct(F.lit(s.name).alias("source"), F.lit(s.priority).alias("priority"), s.url(F.col("id")).alias("url")) for s in sources])
    return ids.select("id", F.explode(each).alias("c")).select("id", "c.*")


def first_answer(pages: DataFrame) -> DataFrame:
    """(id, source, html): of pages (id, source, priority, html, error) the one with the least priority that came without an error."""
    good = pages.where("error is null and html is not null and html <> ''")
    return good.groupBy("id").agg(F.min_by(F.struct("source", "html"), F.struct("priority", "source")).alias("r")).select("id", "r.source", "r.html")


def preferred_member(names: list[str], book_id: int) -> str | None:
    """The page in an archive: by name, else one with "images", else the first of all HTML files."""
    pages = sorted(n for n in names if n.lower().endswith((".html", ".htm")) and not n.endswith("/"))
    base = {n.rpartition("/")[2].lower(): n for n in reversed(pages)}
    for want in (f"pg{book_id}-images.html", f"pg{book_id}-images.htm", f"{book_id}-h.html", f"{book_id}-h.htm"):
        if want in base:
            return base[want]
    return next((n for n in pages if "images" in n.lower()), pages[0] if pages else None)


def page_of_zip(data: bytes, book_id: int) -> str:
    """The text of the preferred page; raises ValueError if there is none."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        name = preferred_member(z.namelist(), book_id)
        if name is None:
            raise ValueError("no HTML file in the archive")
        return z.read(name).decode("utf-8-sig")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(id, html, error) of files named by book id (.html, .htm or .zip) under a folder; unreadable ones have an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select(F.expr(r"try_cast(regexp_extract(path, '(\\d+)[^/]*$', 1) as bigint)").alias("id"), "path", "content").where("id is not null")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, p, data in zip(b["id"], b["path"], b["content"]):
                try:
                    out.append((i, page_of_zip(data, i) if p.lower().endswith(".zip") else data.decode("utf-8-sig"), None))
                except (ValueError, zipfile.BadZipFile, UnicodeDecodeError, KeyError) as x:
                    out.append((i, None, f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(out, columns=["id", "html", "error"])

    return rows.mapInPandas(each, "id bigint, html string, error string")


def catalog_source(cached: bool, fresh: bool, refresh: bool, answered: bool) -> str:
    """Where the catalogue comes from: cache, downloaded or stale_cache. Raises OSError if nowhere."""
    if cached and fresh and not refresh:
        return "cache"
    if answered:
        return "downloaded"
    if cached and not refresh:
        return "stale_cache"
    raise OSError("the catalogue can't be fetched, and none is stored")


def cache_age(path: str | Path) -> float | None:
    """Seconds since the file was written, None if it is missing or empty."""
    p = Path(path)
    try:
        s = p.stat()
    except OSError:
        return None
    return max(0.0, time.time() - s.st_mtime) if s.st_size else None
