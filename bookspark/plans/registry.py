"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bookspark.operators.packed import split_packed
from bookspark.plans import reference
from bookspark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for each value of the packed fields of books."""
    return split_packed(table(spark, d, "books"), "id", ["authors", "subjects", "bookshelves"])


QUERIES: dict[str, Query] = {"p1_found": p1_found} | reference.QUERIES
ORACLE: dict[str, str] = dict(reference.ORACLE)
