"""Filling containers of fixed capacity by minimum bin slack.

What a packing needs to know of the items is how many there are of each length, at most one number per token of
capacity, however many items there are. From these counts the driver makes patterns: the longest length left opens a
container, and a subset-sum over a bitset finds the multiset of remaining lengths that comes closest to filling the
rest; walking back through the steps gives how many of each length it takes. A pattern is used as often as the counts
allow. The containers' places for one length form ranges, and each item finds its place from its rank among the items
of its length. Ranks are counted in salted buckets, so a length that a third of all items share is spread over all
tasks; the patterns, bounded by the capacity alone, are the only thing sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookspark.llm.bpe import TOKENIZERS, token_counts
from bookspark.operators.durable import cut

#: Items in one salted bucket of the ranking, about.
BUCKET = 100_000


def fullest(lengths: list[int], left: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of `lengths` (descending, `left[x]` of each x) with the greatest sum of at most `room`."""
    reached, mask, steps = 1, (2 << room) - 1, []
    for x in lengths:
        n, k = min(left[x], room // x), 1
        while n > 0:
            k = min(k, n)
            new = (reached << x * k) & mask & ~reached
            if new:
                steps.append((x, k, new))
                reached |= new
            n, k = n - k, 2 * k
        if reached >> room:
            break
    at, out = reached.bit_length() - 1, {}
    for x, k, new in reversed(steps):
        if new >> at & 1:
            out[x] = out.get(x, 0) + k
            at -= x * k
    return out


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths with how many of each, how many containers) until every item counted in `counts` has a place. Empty counts give none."""
    left = {x: n for x, n in counts.items() if n > 0 and 0 < x <= capacity}
    lengths, out = sorted(left, reverse=True), []
    while lengths:
        top = lengths[0]
        left[top] -= 1
        used = fullest([x for x in lengths if left[x] and x <= capacity - top], left, capacity - top) if capacity > top else {}
        left[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
        out.append((used, times))
        lengths = [x for x in lengths if left[x]]
    return out


def places(found: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, how many in each container, first container) in order of rank."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    first = 0
    for used, times in found:
        for x, n in used.items():
            rows.setdefault(x, []).append((seen.get(x, 0), n, first))
            seen[x] = seen.get(x, 0) + n * times
        first += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def pack(sizes: DataFrame, key: str, size: str, capacities: dict[str, int]) -> DataFrame:
    """(container_kind, container_id, `key`, piece, start, length): every item of `sizes` once in the containers of each kind.

    An item longer than the capacity is cut into full pieces and the rest; no other is cut. An item of size null or 0
    needs no room: one row with a null container. Rows of an equal key are items of their own. An empty table gives no rows.
    """
    spark = sizes.sparkSession
    kind = sizes.schema[key].dataType.simpleString()
    items = sizes.select(F.col(key).alias("key"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size"))
    table = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(int(c)).cast("bigint").alias("capacity")) for k, c in capacities.items()])
    items = items.select("key", "size", F.explode(table).alias("c")).select("key", "size", "c.*")
    pieces = items.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / F.col("capacity")) - 1, F.lit(0)).cast("int"))).alias("piece"))
    start = F.col("piece") * F.col("capacity")
    pieces = pieces.select("container_kind", "key", "piece", start.alias("start"), F.least(F.col("capacity"), F.col("size") - start).cast("int").alias("length"))

    counts: dict[str, dict[int, int]] = {k: {} for k in capacities}
    total = 0
    for r in pieces.where("length > 0").groupBy("container_kind", "length").count().collect():
        counts[r["container_kind"]][r["length"]] = r["count"]
        total += r["count"]
    sent = spark.sparkContext.broadcast({k: places(patterns(n, capacities[k])) for k, n in counts.items()})

    buckets = max(1, total // BUCKET)
    placed = pieces.where("length > 0").withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)).cast("int"))
    by = ["container_kind", "length", "bucket"]
    before = Window.partitionBy("container_kind", "length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*by).count().select(*by, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("key", "piece")) - 1)
    if buckets > 1:
        ranked = ranked.join(offsets, by).withColumn("rank", F.col("rank") + F.col("offset"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            container = np.zeros(len(b), np.int64)
            for (k, x), at in b.groupby(["container_kind", "length"]).indices.items():
                rows, rank = sent.value[k][x], b["rank"].to_numpy()[at]
                r = rows[np.searchsorted(rows[:, 0], rank, side="right") - 1]
                container[at] = r[:, 2] + (rank - r[:, 0]) // r[:, 1]
            yield pd.DataFrame({"container_kind": b["container_kind"], "container_id": container, key: b["key"], "piece": b["piece"], "start": b["start"], "length": b["length"]})

    columns = f"container_kind string, container_id bigint, `{key}` {kind}, piece int, start bigint, length int"
    ranked = ranked.select("container_kind", "key", "piece", "start", "length", "rank").mapInPandas(each, columns)
    empty = pieces.where("length <= 0").select("container_kind", F.lit(None).cast("bigint").alias("container_id"), F.col("key").alias(key), "piece", "start", "length")
    return ranked.unionByName(empty)


def pack_documents(docs: DataFrame, containers: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """`pack` of the texts, as long as their tokens, into every kind of `containers` (container_kind, tokenizer, capacity: a table that doesn't grow)."""
    kinds = [r for r in containers.select("container_kind", "tokenizer", "capacity").collect() if r["container_kind"] and r["tokenizer"] and (r["capacity"] or 0) > 0]
    out = None
    for tokenizer in sorted({r["tokenizer"] for r in kinds}):
        sizes = cut(token_counts(docs, key, text, tokenizer, folder))
        part = pack(sizes, key, "n_tokens", {r["container_kind"]: r["capacity"] for r in kinds if r["tokenizer"] == tokenizer})
        out = part if out is None else out.unionByName(part)
    if out is None:
        return pack(docs.select(key, F.lit(0).alias("n_tokens")).limit(0), key, "n_tokens", {"none": 1})
    return out
