"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bookspark.llm import bpe, markup, names, neardup, packing, reading, survivors
from bookspark.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.best_records(table(spark, d, "books"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.marked_records(table(spark, d, "texts"), table(spark, d, "chunks"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_corpus(table(spark, d, "texts"), table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_names(table(spark, d, "books"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_records(table(spark, d, "texts"), table(spark, d, "books"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_classes(table(spark, d, "texts"), table(spark, d, "books"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text")


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "container_sizes"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "level_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p3_found, p3_clean, p4_found, p5_found, p5_classes, p6_ids, p7_packing, p8_found)}

_PAIRS = """
select '{tbl}' as tbl, a.id as id_a, b.id as id_b
from (select id, len(g) n from {tbl}_g) a
join (select x.id as i, y.id as j, count(*) as s from {tbl}_u x join {tbl}_u y on x.u = y.u and x.id < y.id group by 1, 2) p on p.i = a.id
join (select id, len(g) n from {tbl}_g) b on p.j = b.id
where s >= {t} * (a.n + b.n - s) - 1e-9
"""
_RUNS = r"""
with texts_v as (select book_id as id, trim(regexp_replace(lower(content), '[^\p{L}\p{N}]+', ' ', 'g')) as v, string_split(trim(regexp_replace(lower(content), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') as w from texts where content is not null),
texts_g as (select id, v, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from texts_v where len(w) >= 3),
texts_u as (select id, unnest(g) as u from texts_g),
books_v as (select id, trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')) as v from books where title is not null),
books_g as (select id, v, list_distinct(list_transform(range(1, length(v) - 1), lambda i: substring(v, i, 3))) as g from books_v where length(v) >= 3),
books_u as (select id, unnest(g) as u from books_g)
"""
_CLASSES = """
select '{tbl}' as tbl, m.id, m.rep, (select count(distinct o.rep) from p join m as o on o.tbl = '{tbl}' and ((p.id_a = m.rep and p.id_b = o.id) or (p.id_b = m.rep and p.id_a = o.id)) where p.tbl = '{tbl}' and o.rep <> m.rep) as links
from m where m.tbl = '{tbl}'
"""
_ALL = _PAIRS.format(tbl="texts", t=0.6) + "union all" + _PAIRS.format(tbl="books", t=0.7)
ORACLE: dict[str, str] = {
    "p5_found": _RUNS + _ALL,
    "p5_classes": _RUNS
    + f""",
p as ({_ALL}),
m as (select 'texts' as tbl, id, min(id) over (partition by v) as rep from texts_g union all select 'books', id, min(id) over (partition by v) from books_g)
"""
    + _CLASSES.format(tbl="texts")
    + "union all"
    + _CLASSES.format(tbl="books"),
}
