"""Books, texts and chunks: lookups, states, windows, section paths; upserts and removal."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bookspark.functions.text import normal_segment

DIVS = ["div1", "div2", "div3", "div4"]
ORDER = ["position", "id"]


def current_chunks(chunks: DataFrame) -> DataFrame:
    """One chunk for each (book_id, position): the one stored last."""
    rest = [c for c in chunks.columns if c not in ("book_id", "position")]
    last = chunks.groupBy("book_id", "position").agg(F.max_by(F.struct(*rest), F.col("id")).alias("r"))
    return last.select("book_id", "position", *[F.col("r")[c].alias(c) for c in rest]).select(*chunks.columns)


def stale_books(books: DataFrame, texts: DataFrame, version: int) -> DataFrame:
    """Books without a text of this version of the chunker; a missing version counts as 1."""
    have = texts.where(F.coalesce("chunker_version", F.lit(1)) == version).select(F.col("book_id").alias("id"))
    return books.join(have, "id", "left_anti")


def text_states(ids: DataFrame, texts: DataFrame, version: int) -> DataFrame:
    """(id, has_text, has_current_text) of the ids."""
    t = texts.select(F.col("book_id").alias("id"), F.lit(True).alias("t"), (F.coalesce("chunker_version", F.lit(1)) == version).alias("c"))
    return ids.select("id").join(t, "id", "left").select("id", F.coalesce("t", F.lit(False)).alias("has_text"), F.coalesce("c", F.lit(False)).alias("has_current_text"))


def chunk_records(chunks: DataFrame, book_id: int, kinds: list[str] | None = None) -> DataFrame:
    """The chunks of a book in order; no kinds means all."""
    out = chunks.where(F.col("book_id") == book_id)
    return (out.where(F.col("kind").isin(kinds)) if kinds else out).orderBy(*ORDER)


def chunk_by_id(chunks: DataFrame, book_id: int, chunk_id: int) -> DataFrame:
    return chunks.where((F.col("book_id") == book_id) & (F.col("id") == chunk_id))


def chunk_by_position(chunks: DataFrame, book_id: int, position: int) -> DataFrame:
    return chunks.where((F.col("book_id") == book_id) & (F.col("position") == position))


def chunk_windows(chunks: DataFrame, centres: DataFrame, around: int) -> DataFrame:
    """The chunks within `around` positions of each centre (book_id, centre) that exists, with the centre.

    Each centre is spread over the positions of its window, so the join is by equal keys, whatever the size of the book.
    """
    there = chunks.select("book_id", F.col("position").alias("centre")).distinct().join(centres.select("book_id", "centre").distinct(), ["book_id", "centre"], "left_semi")
    wanted = there.select("book_id", "centre", F.explode(F.sequence(F.greatest(F.col("centre") - around, F.lit(0)), F.col("centre") + around)).alias("position"))
    return chunks.join(wanted, ["book_id", "position"])


def reconstructed_texts(chunks: DataFrame) -> DataFrame:
    """(book_id, content): contents in order of position, joined by a blank line; null contents are left out."""
    parts = chunks.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("position", "id", "content"))).alias("c"))
    return parts.select("book_id", F.array_join(F.transform("c", lambda x: x["content"]), "\n\n").alias("content"))


def text_of(chunks: DataFrame, book_id: int) -> DataFrame:
    """(book_id, content) of one book, no row if it has no chunks; the filter reaches the scan."""
    return reconstructed_texts(chunks.where(F.col("book_id") == book_id))


def book(books: DataFrame, book_id: int) -> DataFrame:
    """The record of one id."""
    return books.where(F.col("id") == book_id)


def path_segments(path: str) -> list[str]:
    """The non-blank parts of a typed path; more than four are an error."""
    parts = [p for p in path.split("/") if p.strip()]
    if len(parts) > len(DIVS):
        raise ValueError(f"a section path has at most {len(DIVS)} parts")
    return parts


def in_section(path: str) -> Column:
    """Whether a row's divisions lie at or below the path: equal parts, the last may also be the beginning of words. Empty: all rows."""
    wanted = path_segments(path)
    if not wanted:
        return F.lit(True)
    parts = F.transform(F.filter(F.array(*[F.coalesce(F.col(d), F.lit("")) for d in DIVS]), lambda x: F.trim(x) != ""), lambda x: normal_segment(x))
    hit = F.size(parts) >= len(wanted)
    for i, w in enumerate(wanted):
        want, have = normal_segment(F.lit(w)), F.get(parts, F.lit(i))
        hit = hit & ((have == want) | (have.startswith(F.concat(want, F.lit(" "))) if i == len(wanted) - 1 else F.lit(False)))
    return F.coalesce(hit, F.lit(False))


def chunks_by_div(chunks: DataFrame, path: str, book_id: int | None = None, kinds: list[str] | None = None, limit: int = 0) -> DataFrame:
    """The chunks under a section path in order; limit 0 means all."""
    out = chunks.where(in_section(path))
    out = out.where(F.col("book_id") == book_id) if book_id is not None else out
    out = (out.where(F.col("kind").isin(kinds)) if kinds else out).orderBy("book_id", *ORDER)
    return out.limit(limit) if limit > 0 else out


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with the rows of the keys in `new` replaced by those of `new`."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def remove(old: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """`old` without the rows of `ids` (id)."""
    return old.join(ids.select(F.col("id").alias(key)), key, "left_anti")


class Store:
    """Books, texts and chunks as parquet under one folder, each in buckets of book ids. One writer at a time.

    A write puts only the buckets that it touches into a folder of a new version, then a manifest that names for each
    bucket the version that holds it. Readers take the newest manifest, so they see either all of a write or nothing; files
    are never changed. `buckets` is fixed by the first write: a few million chunks each are a good size.
    """

    TABLES = {"books": "id", "texts": "book_id", "chunks": "book_id"}

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _manifest(self) -> dict:
        """{number, buckets, tables: {name: {schema, parts: {bucket: version}}}} of the newest write."""
        fs, path = self._fs()
        found = [f.getPath().getName() for f in fs.listStatus(path(self.root))] if fs.exists(path(self.root)) else []
        done = sorted(x for x in found if x.endswith(".manifest"))
        if not done:
            return {"number": 0, "buckets": self.buckets, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.root}/{done[-1]}", wholetext=True).first()[0])

    def _bucket(self, key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(n)).cast("int")

    def read(self, table: str, only: set[int] | None = None) -> DataFrame | None:
        """The table, or those of its buckets; null if it was never written."""
        known = self._manifest()["tables"].get(table)
        if known is None:
            return None
        schema = T.StructType.fromJson(known["schema"])
        paths = [f"{self.root}/{v}/{table}/bucket={b}" for b, v in sorted(known["parts"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _put(self, changed: dict[str, tuple[DataFrame, set[int] | None]]) -> None:
        """Writes (rows, buckets that they replace; null: all) of the tables given and switches to them."""
        before, fs, path = self._manifest(), *self._fs()
        number, n, tables = before["number"] + 1, before["buckets"], dict(before["tables"])
        version = f"{number:012d}-{uuid.uuid4().hex[:8]}"
        for name, (df, touched) in changed.items():
            key = self.TABLES[name]
            # a book with very many chunks is written by several tasks
            part = [F.floor(F.coalesce("position", F.lit(0)) / 65536)] if name == "chunks" else []
            order = [key, *(["position"] if part else [])]
            df.withColumn("bucket", self._bucket(key, n)).repartition("bucket", *part).sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(f"{self.root}/{version}/{name}")
            made = {f.getPath().getName().partition("=")[2] for f in fs.listStatus(path(f"{self.root}/{version}/{name}")) if f.isDirectory()}
            had = tables.get(name, {"parts": {}})["parts"] if touched is not None else {}
            parts = {b: v for b, v in had.items() if int(b) not in touched} | dict.fromkeys(made, version)
            tables[name] = {"schema": json.loads(df.schema.json()), "parts": parts}
        note = fs.create(path(f"{self.root}/{version}.part"))
        note.write(bytearray(json.dumps({"number": number, "buckets": n, "tables": tables}).encode()))
        note.close()
        fs.rename(path(f"{self.root}/{version}.part"), path(f"{self.root}/{version}.manifest"))

    def _touched(self, ids: DataFrame, key: str, n: int) -> set[int]:
        return {r["b"] for r in ids.select(self._bucket(key, n).alias("b")).distinct().collect()}

    def store(self, books: DataFrame, texts: DataFrame, chunks: DataFrame) -> None:
        """Upserts whole books: their record, text and chunks."""
        n, changed = self._manifest()["buckets"], {}
        for name, df in {"books": books, "texts": texts, "chunks": chunks}.items():
            touched = self._touched(df, self.TABLES[name], n)
            old = self.read(name, touched)
            changed[name] = (df if old is None else upsert(old, df, self.TABLES[name]), touched)
        self._put(changed)

    def remove(self, ids: DataFrame) -> bool:
        """Whether any of the books was there."""
        n = self._manifest()["buckets"]
        touched = self._touched(ids, "id", n)
        books = self.read("books", touched)
        if books is None or books.join(ids.select("id"), "id", "left_semi").isEmpty():
            return False
        self._put({name: (remove(old, ids, key), touched) for name, key in self.TABLES.items() if (old := self.read(name, touched)) is not None})
        return True

    def write(self, **tables: DataFrame) -> None:
        """Replaces whole tables; those not given are kept."""
        self._put({name: (df, None) for name, df in tables.items()})
