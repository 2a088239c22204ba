"""Running sums and maxima over ordered keys without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions in one block.
BLOCK = 4096


def running_sum(df: DataFrame, key: str, position: str, flag: Column, out: str, tie: str | None = None, block: int = BLOCK) -> DataFrame:
    """`df` with `out`: the sum of `flag` over the rows of the same key up to this one, in the order of position (and tie).

    Rows are summed within blocks of positions; only the blocks' totals (a small part of the rows) are summed by key. So a
    key that holds a third of all rows is spread over as many tasks as it has blocks. Null positions come first.
    """
    at = F.floor(F.coalesce(F.col(position), F.lit(-1)) / block).alias("_block")
    rows = df.select("*", at, flag.cast("bigint").alias("_flag"))
    order = [F.col(position), *([F.col(tie)] if tie else [])]
    inside = F.sum("_flag").over(Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("_all").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = rows.groupBy(F.col(key).alias("_k"), F.col("_block").alias("_b")).agg(F.sum("_flag").alias("_all")).select("_k", "_b", before.alias("_before"))
    joined = rows.withColumn("_inside", inside).join(totals, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn(out, F.col("_inside") + F.col("_before")).drop("_block", "_flag", "_inside", "_k", "_b", "_before")


def running_max(df: DataFrame, keys: list[str], position: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """`df` with `out`: the largest `value` of the rows of the same keys up to this one; null if all are null. In blocks, as `running_sum`.

    Null keys are keys like others.
    """
    named = [f"_k{i}" for i in range(len(keys))]
    rows = df.select("*", F.floor(F.coalesce(F.col(position), F.lit(-1)) / block).alias("_block"), value.alias("_value"))
    inside = F.max("_value").over(Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    before = F.max("_all").over(Window.partitionBy(*named).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    tops = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, named)], F.col("_block").alias("_b")).agg(F.max("_value").alias("_all")).select(*named, "_b", before.alias("_before"))
    same = F.col("_block") == F.col("_b")
    for k, n in zip(keys, named):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return rows.withColumn("_inside", inside).join(tops, same).withColumn(out, F.greatest("_inside", "_before")).drop("_block", "_value", "_inside", *named, "_b", "_before")
