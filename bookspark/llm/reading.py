"""Reading level of documents by a latent difficulty model of word occurrence.

How often word w occurs in document d is Poisson with rate n_d * exp(a_w t_d + c_w t_d**2 - b_w): t_d is the level of the
document, b_w how rare the word is, a_w whether it goes with hard or easy text, and c_w lets a word belong to a middle level.
Both sides are estimated in turn. A pass over all documents finds each t_d on a grid, given the words, and adds up word
counts by grid point; this table of (grid points) x (words) holds all that the words' parameters depend on, so they are
fitted on the driver by Newton steps. No document leaves the executors.

The words are those in at least `SHARE` of all English documents: at most (mean number of different words) / SHARE.
Cuts between the levels are set where they contradict the fewest given labels; the labels are counted by level and
fine bins of t, all of them.
"""

from __future__ import annotations

import itertools
import logging
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.operators.durable import cut
from bookspark.operators.layout import spread

log = logging.getLogger(__name__)
SHARE, PASSES, TOLERANCE, RIDGE, PRIOR, BINS = 0.004, 6, 0.01, 5.0, 0.25, 4000
GRID = np.linspace(-3, 3, 61)
# Joining words of English, and the least share of them in an English text.
JOINING = frozenset("the a an of and was it in by he she they we had that which to with not his her its were no from but who at for is as on be this have i you so".split())
ENGLISH = 0.16
_RUN = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Words in small letters, without soft hyphens and old long s."""
    return _RUN.findall(text.replace("\xad", "").replace("﻿", "").replace("ſ", "s").lower())


def _usable(text: str | None, least: int) -> list[str] | None:
    """The words of an English text with at least `least` runs of letters, else None."""
    if not isinstance(text, str) or len(text) < 2 * least - 1 or len(_RUN.findall(text)) < least:
        return None
    w = words(text)
    return w if w and sum(x in JOINING for x in w) >= ENGLISH * len(w) else None


def _curve(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log rates of the words (rows) at the levels `t`."""
    return p[:, :1] * -1 + p[:, 1:2] * t + p[:, 2:3] * t * t


def _fit_words(p: np.ndarray, x: np.ndarray, n: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Newton steps for (b, a, c) of each word from counts `x` (grid, word) and lengths `n` (grid); then t is scaled to mean 0 and deviation 1."""
    d = np.stack([np.ones_like(GRID), GRID, GRID**2], 1)
    for _ in range(6):
        m = n * np.exp(np.clip(_curve(p, GRID), -30, 3))
        g = (x.T - m) @ d
        h = np.einsum("wg,gi,gj->wij", m, d, d) + np.diag([1e-3, RIDGE, RIDGE])
        g[:, 1:] -= RIDGE * p[:, 1:]
        step = np.clip(np.linalg.solve(h, g[:, :, None])[:, :, 0], -1, 1)
        p = p + step * np.array([-1, 1, 1])
    mean = (docs * GRID).sum() / docs.sum()
    sd = max(((docs * (GRID - mean) ** 2).sum() / docs.sum()) ** 0.5, 1e-3)
    b, a, c = p.T
    return np.stack([b - a * mean - c * mean**2, sd * (a + 2 * c * mean), c * sd * sd], 1)


def _levels(index: list[np.ndarray], count: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """The most likely t of each document, between grid points by a parabola."""
    eta = _curve(p, GRID)
    rate = np.exp(np.clip(eta, -30, 3)).sum(0)
    out = np.zeros(len(index))
    for i, (k, c) in enumerate(zip(index, count)):
        ll = c @ eta[k] - c.sum() * rate - PRIOR * GRID**2
        j = int(ll.argmax())
        if 0 < j < len(GRID) - 1:
            l, m, r = ll[j - 1 : j + 2]
            out[i] = GRID[j] + (GRID[1] - GRID[0]) * 0.5 * (l - r) / min(l - 2 * m + r, -1e-12)
        else:
            out[i] = GRID[j]
    return out


def latent_levels(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 50) -> DataFrame:
    """(`key`, t) of the English texts with at least `least` runs of letters; t grows with difficulty (mean 0, deviation 1).

    Null, blank, short and foreign texts have no row. Repeated rows come out repeated. An empty table gives no rows.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    source = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["key"], b["text"]):
                if w := _usable(t, least):
                    n = Counter(w)
                    out.append((k, " ".join(n), list(n.values()), sum(map(len, w)) / len(w)))
            yield pd.DataFrame(out, columns=["key", "words", "n", "size"])

    # each text is read once: its different words in one string, and how often each comes
    kept = cut(source.mapInPandas(read, f"key {kind}, words string, n array<int>, size double"))
    total = kept.count()
    counted = kept.select(F.explode(F.split("words", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    vocabulary = sorted(r["word"] for r in counted.where((F.col("n") >= SHARE * total) & (F.col("n") < total)).collect())
    number = spark.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def matrix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = number.value
        for b in batches:
            found = [[(ix[x], c) for x, c in zip(w.split(" "), n) if x in ix] for w, n in zip(b["words"], b["n"])]
            yield pd.DataFrame({"key": b["key"], "i": [[i for i, _ in f] for f in found], "n": [[c for _, c in f] for f in found], "size": b["size"]})

    rows = cut(kept.mapInPandas(matrix, f"key {kind}, i array<int>, n array<int>, size double"))
    mean, sd = rows.agg(F.avg("size"), F.stddev_pop("size")).first()
    m = len(vocabulary)
    if not m:
        return rows.select(F.col("key").alias(key), F.lit(0.0).alias("t"))
    p: np.ndarray | None = None
    for turn in itertools.count(1):
        sent = spark.sparkContext.broadcast(p)

        def tally(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            x, n, docs = np.zeros((len(GRID), m)), np.zeros(len(GRID)), np.zeros(len(GRID))
            for b in batches:
                t = _levels(list(b["i"]), list(b["n"]), sent.value) if sent.value is not None else (b["size"].to_numpy() - mean) / (sd or 1)
                g = np.rint((np.clip(t, GRID[0], GRID[-1]) - GRID[0]) / (GRID[1] - GRID[0])).astype(int)
                for j, k, c in zip(g, b["i"], b["n"]):
                    x[j, k] += c
                    n[j] += c.sum()
                    docs[j] += 1
            # counts that aren't 0; words on, behind the last word the lengths and the documents
            all_ = np.concatenate([x, n[:, None], docs[:, None]], 1)
            g, w = np.nonzero(all_)
            yield pd.DataFrame({"g": g.astype(np.int32), "w": w.astype(np.int32), "c": all_[g, w]})

        # summed before the shuffle and after it; what comes to the driver is bounded by the grid and the vocabulary
        got = rows.select("i", "n", "size").mapInPandas(tally, "g int, w int, c double").groupBy("g", "w").agg(F.sum("c").alias("c")).toPandas()
        all_ = np.zeros((len(GRID), m + 2))
        all_[got["g"], got["w"]] = got["c"]
        x, n, docs_at = all_[:, :m], all_[:, m], all_[:, m + 1]
        if p is None:
            p = np.zeros((m, 3))
            p[:, 0] = -np.log(np.maximum(x.sum(0), 0.5) / max(n.sum(), 1))
        fitted = _fit_words(p, x, n, docs_at)
        # steps are halved from `PASSES` on, so the estimates come to rest in any case
        p, before = p + 0.5 ** max(0, turn - PASSES) * (fitted - p), p
        moved = float(np.sqrt((n[:, None] * (_curve(p, GRID) - _curve(before, GRID)).T ** 2).sum() / max(n.sum() * m, 1)))
        log.info("reading levels, pass %d: log rates moved by %.3g", turn, moved)
        if turn > 1 and moved <= TOLERANCE:
            break
    final = spark.sparkContext.broadcast(p)

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b["key"], "t": _levels(list(b["i"]), list(b["n"]), final.value)})

    return rows.select("key", "i", "n").mapInPandas(level, f"`{key}` {kind}, t double")


def _cuts(table: pd.DataFrame) -> list[float]:
    """Where the levels 1|2, 2|3 ... part, from counts `n` by `bin` and `level`: the fewest contradicted labels, in the middle of equal ones."""
    out, at = [], np.arange(BINS + 1)
    for k in range(1, 5):
        low, high = np.zeros(BINS), np.zeros(BINS)
        np.add.at(low, table["bin"][table["level"] <= k], table["n"][table["level"] <= k])
        np.add.at(high, table["bin"][table["level"] > k], table["n"][table["level"] > k])
        wrong = np.concatenate([[0], high.cumsum()]) + low.sum() - np.concatenate([[0], low.cumsum()])
        best = at[wrong == wrong.min()]
        run = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
        widest = max(run, key=len)
        out.append(GRID[0] + (GRID[-1] - GRID[0]) * (widest[0] + widest[-1]) / 2 / BINS)
    return np.maximum.accumulate(out).tolist()


def reading_levels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, level), level 1 to 5, of every English text with at least 50 runs of letters; `labels`: (doc_id, level), some documents several times, some levels null or wrong."""
    t = cut(latent_levels(docs))
    given = labels.where("level between 1 and 5").select("doc_id", "level")
    place = F.least(F.greatest(F.floor((F.col("t") - float(GRID[0])) / float(GRID[-1] - GRID[0]) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    table = t.join(given, "doc_id").groupBy(place.alias("bin"), "level").agg(F.count("*").alias("n")).toPandas()
    cuts = _cuts(table)
    level = sum(((F.col("t") > c).cast("int") for c in cuts), F.lit(1))
    return t.select("doc_id", level.alias("level"))
