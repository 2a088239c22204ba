"""Cutting of lineage that survives the loss of executors."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session (`spark.checkpoint.dir`); a local one is made only where none is named, as in tests."""
    sc = spark.sparkContext
    if (had := sc.getCheckpointDir()) is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
            named = os.path.join(tempfile.gettempdir(), f"bookspark-{os.getuid()}")
        sc.setCheckpointDir(named)
        had = named
    return had


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there: later stages don't repeat its work, and a lost executor loses nothing.

    The rows are kept while the checkpoint copies them, else they would be computed twice.
    """
    checkpoint_dir(df.sparkSession)
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        return kept.checkpoint(eager=True)
    finally:
        kept.unpersist()
