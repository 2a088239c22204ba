"""The catalogue: policy, works listed twice, search, requests."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookspark.functions.text import primary_author, work_text

FIELDS = ["title", "authors", "language", "subjects", "locc", "bookshelves", "issued", "type"]
# The columns of the feed.
CSV_COLUMNS = {"Text#": "id", "Type": "type", "Issued": "issued", "Title": "title", "Language": "language", "Authors": "authors", "Subjects": "subjects", "LoCC": "locc", "Bookshelves": "bookshelves"}


@dataclass(frozen=True)
class Policy:
    """Which records are kept: languages, media types, whether works listed twice are made one ("canonical" or "none")."""

    languages: frozenset[str] = field(default_factory=lambda: frozenset({"en"}))
    types: frozenset[str] = field(default_factory=lambda: frozenset({"text"}))
    dedupe: str = "canonical"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Records of a CSV feed (also gzipped), quoted fields may span lines; rows without a whole number as id are left out."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in CSV_COLUMNS])
    raw = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    rows = raw.select(F.expr("try_cast(trim(`Text#`) as bigint)").alias("id"), *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in CSV_COLUMNS.items() if n != "id"])
    return rows.where("id is not null").select("id", *FIELDS)


def allowed(policy: Policy) -> Column:
    """Whether a record has an allowed type and at least one allowed language."""
    kind = F.lower(F.trim(F.coalesce("type", F.lit(""))))
    codes = F.transform(F.split(F.lower(F.coalesce("language", F.lit(""))), r"[;,/|]+"), lambda x: F.trim(x))
    return kind.isin(sorted(policy.types)) & F.arrays_overlap(codes, F.array(*[F.lit(x) for x in sorted(policy.languages)]))


def first_per_id(records: DataFrame, order: str | None = None) -> DataFrame:
    """One record per id: the first by `order`, then by content, so that the choice doesn't depend on how rows are spread."""
    rest = [c for c in records.columns if c != "id"]
    rank = F.struct(*([order] if order else []), *[c for c in rest if c != order])
    return records.groupBy("id").agg(F.min(rank).alias("r")).select("id", *[F.col("r")[c].alias(c) for c in rest]).select(*records.columns)


def canonical_map(records: DataFrame) -> DataFrame:
    """(id, canonical_id): the smallest id of records of the same title and first author; a record without either stands for itself.

    A grouped minimum joined back, not a window: a title that a third of all rows bear isn't sorted in one task.
    """
    keyed = records.select("id", work_text("title").alias("t"), work_text(primary_author("authors")).alias("a"))
    known = (F.col("t") != "") & (F.col("a") != "")
    least = keyed.where(known).groupBy("t", "a").agg(F.min("id").alias("canonical_id"))
    # records without a key take no part in the join, where they would all be one key
    alone = keyed.where(~known).select("id", F.col("id").alias("canonical_id"))
    return keyed.where(known).join(least, ["t", "a"]).select("id", "canonical_id").union(alone).distinct()


def catalog(records: DataFrame, policy: Policy | None = None, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records kept, map of ids) under the policy. Of records of one id the first by `order` stays (as of a column that numbers arrivals)."""
    policy = policy or Policy()
    kept = first_per_id(records.where(allowed(policy)), order)
    if policy.dedupe == "none":
        return kept, kept.select("id", F.col("id").alias("canonical_id"))
    links = canonical_map(kept)
    return kept.join(links.select(F.col("canonical_id").alias("id")).distinct(), "id", "left_semi"), links


def canonical_records(wanted: DataFrame, links: DataFrame, kept: DataFrame) -> DataFrame:
    """(request_id, record columns) of the requested ids (request_id): the record that stands for each; null columns for unknown ids."""
    of = wanted.join(links.withColumnRenamed("id", "request_id"), "request_id", "left")
    return of.join(kept.withColumn("canonical_id", F.col("id")), "canonical_id", "left").drop("canonical_id")


def catalog_page(found: DataFrame, limit: int) -> DataFrame:
    """The first `limit` records found, in order of id, each with `total` matches and `remaining` ones that aren't shown."""
    limit, total = max(limit, 0), found.count()
    return found.orderBy("id").limit(limit).withColumns({"total": F.lit(total).cast("bigint"), "remaining": F.lit(max(total - limit, 0)).cast("bigint")})


def _match(column: str, query: str) -> Column:
    c, words = F.lower(F.coalesce(column, F.lit(""))), query.lower().split()
    hit = c.contains(query.strip().lower())
    if len(words) > 1:
        every = F.lit(True)
        for w in words:
            every = every & c.contains(w)
        hit = hit | every
    return hit


def search_catalog(records: DataFrame, author: str = "", title: str = "", language: str = "", subject: str = "") -> DataFrame:
    """Records in which each given field holds the phrase, or all of its words; in order of id."""
    out = records
    for column, query in (("authors", author), ("title", title), ("language", language), ("subjects", subject)):
        if query.strip():
            out = out.where(_match(column, query))
    return out.orderBy("id")


def requests(wanted: DataFrame, links: DataFrame) -> DataFrame:
    """(request_pos, id, canonical_id, status) of requested ids (request_pos, id): requested, duplicate_requested or missing."""
    found = wanted.join(links, "id", "left")
    first = found.where("canonical_id is not null").groupBy("canonical_id").agg(F.min("request_pos").alias("first_pos"))
    status = F.when(F.col("canonical_id").isNull(), "missing").when(F.col("request_pos") == F.col("first_pos"), "requested").otherwise("duplicate_requested")
    return found.join(first, "canonical_id", "left").select("request_pos", "id", "canonical_id", status.alias("status"))
