"""Streams: new pages into the store, and the catalogue feed by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bookspark.operators.ingest import ingest
from bookspark.operators.store import Store

FEED = "feed_id bigint, batch_day int, received_at timestamp_ntz, text_no string, type string, issued string, title string, language string, authors string, subjects string, locc string, bookshelves string"


def read_feed(spark: SparkSession, folder: str, files: int = 10) -> DataFrame:
    """The deliveries of the catalogue as a stream of parquet files."""
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files).parquet(folder)


def deliveries_by_day(feed: DataFrame, late: str = "120 days") -> DataFrame:
    """(day, records) by the day of receipt; records that come more than `late` after the newest are left out, copies of one feed_id count once."""
    at = feed.withColumn("at", F.col("received_at").cast("timestamp")).withWatermark("at", late)
    return at.dropDuplicatesWithinWatermark(["feed_id"]).groupBy(F.window("at", "1 day").alias("w")).agg(F.count("*").alias("records")).select(F.to_date("w.start").alias("day"), "records")


def ingest_stream(store: Store, books: DataFrame, pages: DataFrame, checkpoint: str) -> StreamingQuery:
    """Ingests each micro-batch of pages (id, html); a batch that comes again changes nothing, as whole books are replaced."""

    def batch(rows: DataFrame, _: int) -> None:
        known = books.join(rows.select("id").distinct(), "id", "left_semi")
        ingest(store, known, rows.groupBy("id").agg(F.max("html").alias("html")), force=True)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
