"""Ingest: which books to read, their chunks, and what became of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.html.chunker import CHUNKER_VERSION, chunk_books
from bookspark.operators.durable import cut
from bookspark.operators.store import Store, reconstructed_texts, text_states


def plan_ingest(books: DataFrame, texts: DataFrame, force: bool = False, version: int = CHUNKER_VERSION) -> DataFrame:
    """(id, action): skip for books with a current text unless forced, else reprocess or add."""
    states = text_states(books, texts, version)
    action = F.when(F.col("has_current_text") & ~F.lit(force), "skip").when(F.col("has_text"), "reprocess").otherwise("add")
    return states.select("id", action.alias("action"))


def ingest(store: Store, books: DataFrame, pages: DataFrame, force: bool = False) -> DataFrame:
    """(id, status) of the books: added, reprocessed, skipped_current or failed. Failures are reported, not raised.

    `pages`: (id, html). Books without a page or without any chunk fail and leave the store as it was.
    """
    spark = books.sparkSession
    had = store.read("texts")
    had = had if had is not None else spark.createDataFrame([], "book_id bigint, content string, chunker_version int, downloaded_at timestamp")
    todo = cut(plan_ingest(books, had, force))
    wanted = pages.join(todo.where("action <> 'skip'"), "id", "left_semi").select(F.col("id").alias("book_id"), "html")
    chunks = cut(chunk_books(wanted))
    good = chunks.where("error is null").drop("error")
    keyed = good.withColumn("id", F.xxhash64("book_id", "position"))
    done = good.select(F.col("book_id").alias("id")).distinct()
    report = todo.join(done.withColumn("done", F.lit(True)), "id", "left")
    status = F.when(F.col("action") == "skip", "skipped_current").when(F.col("done").isNull(), "failed").when(F.col("action") == "reprocess", "reprocessed").otherwise("added")
    report = cut(report.select("id", status.alias("status")))
    if not done.isEmpty():
        texts = reconstructed_texts(keyed).select("book_id", "content", F.lit(CHUNKER_VERSION).alias("chunker_version"), F.current_timestamp().alias("downloaded_at"))
        store.store(books.join(done, "id", "left_semi"), texts, keyed)
    return report
