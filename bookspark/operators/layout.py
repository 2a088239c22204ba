"""Spreading rows over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def wide(spark: SparkSession) -> int:
    """Partitions for a step of few bytes and much work, which adaptive execution would put into a few tasks by its bytes."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` in enough partitions for all cores; unchanged if it has them. Small files come as one partition, which would run Python on one core."""
    spark = df.sparkSession
    if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(wide(spark), *keys)
