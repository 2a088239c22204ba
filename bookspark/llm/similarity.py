"""Sparse cosine joins and average-linkage clustering, both distributed."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookspark.operators.durable import cut
from bookspark.operators.layout import wide

#: A gram of more rows than this is joined in blocks of about so many rows.
BLOCK = 1024
#: Dot products are taken of so many rows with as many.
ROWS = 256


def merged(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """A sort-merge join: sizes of checkpointed tables are only estimated, and neither side may be broadcast on an estimate."""
    return left.join(right.hint("shuffle_merge"), on, how)


def dots(one: list[tuple], other: list[tuple], threshold: float) -> list[tuple[int, int, float]]:
    """(a, b, dot product), a < b, of at least `threshold`, of the rows (id, codes, weights) of `one` with those of `other`."""
    cx, cy = (np.concatenate([r[1] for r in rows]) for rows in (one, other))
    if one is other:
        codes, n = np.unique(cx, return_counts=True)
        codes = codes[n > 1]
    else:
        codes = np.intersect1d(cx, cy)
    if not len(codes):
        return []

    def dense(rows: list[tuple], c: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
        known = codes[at] == c
        out = np.zeros((len(rows), len(codes)))
        out[np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])[known], at[known]] = np.concatenate([r[2] for r in rows])[known]
        return out

    m = dense(one, cx)
    found = m @ (m if one is other else dense(other, cy)).T
    a, b = np.array([r[0] for r in one]), np.array([r[0] for r in other])
    x, y = np.nonzero(found >= threshold - 1e-9)
    keep = a[x] < b[y] if one is other else a[x] != b[y]
    x, y = x[keep], y[keep]
    return list(zip(np.minimum(a[x], b[y]).tolist(), np.maximum(a[x], b[y]).tolist(), found[x, y].tolist()))


def cosine_join(rows: DataFrame, threshold: float, top: int | None = None, power: float = 1.0) -> DataFrame:
    """(a, b, cosine), a < b, of the rows whose weighted vectors have a cosine of at least `threshold`; exact and lossless.

    `rows`: (id: bigint, grams: array<string>), each id and each gram of a row once; a gram weighs log(1 + N / rows with
    it) to the `power`. Other columns don't matter. Rows with null or empty grams are in no pair, an empty table gives none. `top`: of
    each row only the pairs with the `top` nearest, ties by the smaller id of the other; a pair stays if either row keeps it. None keeps all.

    The grams of all rows are in one order, from the rarest. The last ones of a row, while together shorter than
    `threshold` of its length, are not joined. If the first common gram of two rows is one of those, so are all common grams
    of that row, and the rows can't reach the threshold. Frequent grams are joined only for rows that have little else, and in
    blocks: the rows of a gram are dealt to k blocks, and each two blocks meet once, in a cell of their own. Rows bring
    their whole vectors to the cells, where the dot products are taken at once: only pairs that reach the threshold leave
    a task, and what is shuffled grows with the rows of the cells, not with the pairs that meet there.
    """
    spark, n = rows.sparkSession, float(rows.count())
    flat = rows.select("id", F.explode("grams").alias("g"))
    df = cut(flat.groupBy("g").agg(F.count("*").alias("df")).withColumn("code", F.monotonically_increasing_id()))
    weighted = merged(flat, df, "g").withColumn("w2", F.pow(F.log1p(F.lit(n) / F.col("df")), 2 * power))
    order, whole = Window.partitionBy("id").orderBy("df", "g"), Window.partitionBy("id")
    vectors = weighted.withColumn("rest", F.sum("w2").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))).withColumn("all", F.sum("w2").over(whole))
    vectors = cut(vectors.select("id", "code", "df", "rest", "all", (F.sqrt("w2") / F.sqrt("all")).alias("w")))
    # grams of one row are in its length, but in no dot product
    arrays = vectors.where("df > 1").groupBy("id").agg(F.collect_list(F.struct("code", "w")).alias("v")).select("id", F.col("v.code").alias("codes"), F.col("v.w").alias("w"))

    # each row of a gram goes to the pairs of blocks that its block is in; a number of partitions of its own, as few rows make many pairs
    heads = vectors.where((F.col("df") > 1) & (F.col("rest") >= (threshold - 1e-9) ** 2 * F.col("all"))).withColumn("k", F.ceil(F.col("df") / BLOCK).cast("int"))
    heads = heads.withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.least("own", o) * F.col("k") + F.greatest("own", o))
    cells = merged(heads.select("id", "code", "k", "own"), arrays, "id").select("id", "code", "own", F.explode(meets).alias("cell"), (F.col("own") * (F.col("k") + 1)).alias("alone"), "codes", "w")
    cells = cells.repartition(wide(spark), "code", "cell").sortWithinPartitions("code", "cell", "own")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def answer(held: list[list[tuple]]) -> pd.DataFrame:
            # rows of one block, or of several small cells, meet each other; those of two blocks only the other's
            parts = [[rows[i : i + ROWS] for i in range(0, len(rows), ROWS)] for rows in held]
            pairs = itertools.combinations_with_replacement(parts[0], 2) if len(parts) == 1 else itertools.product(*parts)
            found = {(a, b): s for x, y in pairs for a, b, s in dots(x, y, threshold)}
            return pd.DataFrame([(a, b, s) for (a, b), s in found.items()], columns=["a", "b", "cosine"])

        at, pool, blocks = None, [], {}
        for batch in batches:
            for i, code, own, cell, alone, codes, w in zip(*(batch[c] for c in ("id", "code", "own", "cell", "alone", "codes", "w"))):
                if (code, cell) != at:
                    if len(blocks) == 2:
                        yield answer(list(blocks.values()))
                    if len(pool) >= ROWS // 2:
                        yield answer([pool])
                        pool = []
                    at, blocks = (code, cell), {}
                if cell == alone:
                    pool.append((i, codes, w))
                else:
                    blocks.setdefault(own, []).append((i, codes, w))
        if len(blocks) == 2:
            yield answer(list(blocks.values()))
        if pool:
            yield answer([pool])

    # a pair that shares several grams meets as often; its sums differ at most in their last bits
    found = cells.mapInPandas(each, "a bigint, b bigint, cosine double").groupBy("a", "b").agg(F.min("cosine").alias("cosine"))
    if top is None:
        return found
    found = cut(found)
    both = found.select(F.col("a").alias("x"), F.col("b").alias("y"), "a", "b", "cosine").union(found.select("b", "a", "a", "b", "cosine"))
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc(F.round("cosine", 12)), "y"))
    return both.withColumn("rank", rank).where(F.col("rank") <= top).select("a", "b", "cosine").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes of `edges` (a, b), a <> b; `component` is the smallest id that a node is linked to.

    Large and small stars in turn: each node's larger neighbours, then its smaller ones, are linked to the smallest, until
    nothing moves. Neighbours are only aggregated, never gathered, so a node may have any number of them.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = merged(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = merged(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m")).distinct()
        now = cut(small)
        # the sum of hashes is of the set of links: it is the same twice only when nothing moves
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if new == mark:
            break
        mark = new
    star = now.toDF("id", "component")
    return star.union(star.select(F.col("component").alias("id"), "component").distinct())


def agglomerate(edges: Iterable[tuple[int, int, float]], threshold: float) -> dict[int, int]:
    """The cluster of each node by average linkage of the `edges` of one component, the nearest pair first; ties go to smaller ids."""
    links: dict[int, dict[int, float]] = {}
    for a, b, s in edges:
        for x, y in ((a, b), (b, a)):
            links.setdefault(x, {})[y] = links.get(x, {}).get(y, 0.0) + s
    size, into = dict.fromkeys(links, 1), {x: x for x in links}
    heap = [(-round(s, 12), a, b, 1, 1) for a, near in links.items() for b, s in near.items() if a < b and s >= threshold - 1e-12]
    heapq.heapify(heap)
    while heap:
        _, a, b, na, nb = heapq.heappop(heap)
        if size.get(a) != na or size.get(b) != nb:
            continue  # one of them has grown since
        into[b] = a
        size[a] += size.pop(b)
        gone = links.pop(b)
        del links[a][b], gone[a]
        for c, s in gone.items():
            links[a][c] = links[c][a] = links[a].get(c, 0.0) + s
            del links[c][b]
        for c, s in links[a].items():
            if (mean := s / (size[a] * size[c])) >= threshold - 1e-12:
                x, y = min(a, c), max(a, c)
                heapq.heappush(heap, (-round(mean, 12), x, y, size[x], size[y]))
    for x in sorted(into):
        into[x] = into[into[x]]
    return into


def average_linkage(nodes: DataFrame, pairs: DataFrame, threshold: float, most: int = 1 << 16) -> DataFrame:
    """(id, cluster) of `nodes` (id) by average linkage of `pairs` (a, b, s; each pair once, missing pairs have s = 0).

    Clusters never reach over connected components. Components of at most `most` pairs are clustered each at once, in
    the task that has it; larger ones by `linkage_rounds`, which gathers nothing. The cluster's name is its smallest id.
    """
    edges = cut(pairs.select("a", "b", F.col("s").cast("double").alias("s")).where(F.col("s") > 0))
    of = cut(components(edges))
    known = cut(merged(edges, of.select(F.col("id").alias("a"), "component"), "a"))
    size = cut(known.groupBy("component").agg(F.count("*").alias("n")))
    large = size.where(F.col("n") > most).select("component")
    small = merged(known, size.where(F.col("n") <= most).select("component"), "component")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for b in batches:
            out: list[tuple[int, int]] = []
            for c, x, y, s in zip(b["component"], b["a"], b["b"], b["s"]):
                if c != at:
                    out += agglomerate(held, threshold).items()
                    at, held = c, []
                held.append((x, y, s))
            yield pd.DataFrame(out, columns=["id", "cluster"])
        yield pd.DataFrame(list(agglomerate(held, threshold).items()), columns=["id", "cluster"])

    sorted_ = small.select("component", "a", "b", "s").repartition("component").sortWithinPartitions("component")
    found = sorted_.mapInPandas(each, "id bigint, cluster bigint")
    if not large.isEmpty():
        inner = merged(known, large, "component")
        members = merged(of, large, "component").select("id")
        found = found.union(linkage_rounds(members, inner.select("a", "b", "s"), threshold))
    return merged(nodes.select("id"), found, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def linkage_rounds(nodes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(id, cluster) of `nodes` (id) by average linkage of `pairs` (a, b, s; each pair once, missing pairs have s = 0).

    In each round every cluster finds its nearest neighbour, and clusters that are each other's nearest (ties by a
    hash of the pair, new in each round, so that many of equal pairs are merged at once) are merged. Average linkage never
    brings a merged cluster nearer to a third than both parts were, so, but for ties, this gives the same clusters as
    merging one pair at a time, down to `threshold`. The cluster's name is its smallest id.
    """
    member = cut(nodes.select("id", F.col("id").alias("cluster")))
    edges = cut(pairs.select("a", "b", F.col("s").cast("double").alias("s")))
    for turn in itertools.count():
        size = member.groupBy("cluster").agg(F.count("*").cast("double").alias("n"))
        mean = F.col("s") / (F.col("na") * F.col("nb"))
        near = merged(merged(edges, size.toDF("a", "na"), "a"), size.toDF("b", "nb"), "b").withColumn("m", mean).where(F.col("m") >= threshold - 1e-12)
        both = near.select(F.col("a").alias("x"), F.col("b").alias("y"), "m").union(near.select(F.col("b"), F.col("a"), "m"))
        low, high = F.least("x", "y"), F.greatest("x", "y")
        rank = F.struct(F.round("m", 12).alias("m"), F.xxhash64(F.lit(turn), low, high).alias("tie"), low.alias("l"), high.alias("h"))
        best = both.groupBy("x").agg(F.max_by("y", rank).alias("y"))
        other = best.toDF("y", "back")
        merge = cut(merged(best, other, "y").where(F.col("back") == F.col("x")).where("x > y").select(F.col("x").alias("old"), F.col("y").alias("new")))
        if merge.isEmpty():
            break
        to = lambda df, c: merged(df, merge.toDF(c, "new"), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        member = cut(to(member, "cluster").select("id", "cluster"))
        moved = to(to(edges, "a"), "b").where("a <> b")
        edges = cut(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s")))
    return member
