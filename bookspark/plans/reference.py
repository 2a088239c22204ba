"""Queries over the whole tables for each operator of the engine, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookspark.functions import text as X
from bookspark.operators import catalog as C
from bookspark.operators import fulltext as T
from bookspark.operators import sections as S
from bookspark.operators import store as R
from bookspark.operators.durable import checkpoint_dir
from bookspark.plans.samples import PAGES
from bookspark.sources.tables import state, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
VERSION = 3
EN = C.Policy()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- SQL fragments
def _of(template: str, sql: str) -> str:
    """The fragment with `sql` in the place of {c}."""
    return template.replace("{c}", sql)


_WORK = r"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"
_AUTHOR = r"trim(regexp_replace(split_part(coalesce(authors, ''), ';', 1), '(\s*(\[[^\]]+\]|\([^)]+\)))+\s*$', ''))"
_ALLOWED = r"lower(trim(coalesce(type, ''))) = 'text' and list_contains(list_transform(regexp_split_to_array(lower(coalesce(language, '')), '[;,/|]+'), lambda x: trim(x)), 'en')"
_KEYED = f"select *, {_of(_WORK, 'title')} as t, trim(regexp_replace(lower({_AUTHOR}), '[^a-z0-9]+', ' ', 'g')) as a from books where {_ALLOWED}"
_MAP = f"with k as ({_KEYED}) select id, case when t <> '' and a <> '' then min(id) over (partition by t, a) else id end as canonical_id from k"
_LINE = r"trim(regexp_replace({c}, '[\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{1680}\x0b]+', ' ', 'g'))"
_PARTS = "list_filter([coalesce(div1, ''), coalesce(div2, ''), coalesce(div3, ''), coalesce(div4, '')], lambda x: trim(x) <> '')"
_PATH = f"array_to_string({_PARTS}, ' / ')"
_WORDS = "cast(round({c} / 5) as bigint)"
_READ = "case when {c} <= 0 then 'n/a' when greatest(cast(round_even({c} / 250.0, 0) as bigint), 1) >= 60 then (greatest(cast(round_even({c} / 250.0, 0) as bigint), 1) // 60)::varchar || 'h ' || (greatest(cast(round_even({c} / 250.0, 0) as bigint), 1) % 60)::varchar || 'm' else greatest(cast(round_even({c} / 250.0, 0) as bigint), 1)::varchar || 'm' end"
_NORM = "trim(regexp_replace(regexp_replace(lower(" + _LINE + r"), '\s*([.,;:!?])\s*', '\1', 'g'), '[\s.,;:!?\"''’”)\]}»]+$', ''))"

_STRIP = r"regexp_replace(w, '^[()\[\]{}\x{22}\x{27}“”‘’,;:\-]+|[()\[\]{}\x{22}\x{27}“”‘’,;:\-]+$', '', 'g')"
_FITS = r"(regexp_full_match(w, '(?i)[ivxlcdm]+') or (regexp_matches(w, '\p{Lu}') and not regexp_matches(w, '\p{Ll}')) or (regexp_full_match(w, '[A-Za-z]+(?:[\x{27}’][A-Za-z]+)*') and (lower(w) in ('a', 'an', 'and', 'as', 'at', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'the', 'to', 'with') or regexp_full_match(w, '[A-Z][^A-Z]*'))))"
_TITLED = f"list_filter(list_transform(string_split({{c}}, ' '), lambda w: {_STRIP}), lambda w: w <> '')"
_TITLE = rf"(len({_TITLED}) between 1 and 8 and not regexp_matches({{c}}, '[.!?][\x{{22}}\x{{27}})\]]*$|[,;]') and len(list_filter({_TITLED}, lambda w: not {_FITS})) = 0)"


# ---- catalogue
@query("select id, title, authors, language, subjects, locc, bookshelves, issued, type from books")
def books_list(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "books").orderBy("id")


@query(f"select id, title, language, type from books where {_ALLOWED}")
def catalog_policy(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "books").where(C.allowed(EN)).select("id", "title", "language", "type")


@query("select try_cast(trim(text_no) as bigint) as id, count(*) as n from catalog_feed where try_cast(trim(text_no) as bigint) is not null and regexp_matches(trim(text_no), '^[+-]?\\d+$') group by 1")
def catalog_feed_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "catalog_feed").select(F.expr("try_cast(trim(text_no) as bigint)").alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("n"))


@query(_MAP)
def catalog_canonical_map(s: SparkSession, d: str) -> DataFrame:
    return C.canonical_map(table(s, d, "books").where(C.allowed(EN)))


@query(f"select id, title from books where id in (select canonical_id from ({_MAP}) m)")
def catalog_dedupe(s: SparkSession, d: str) -> DataFrame:
    return C.catalog(table(s, d, "books"))[0].select("id", "title")


@query(f"select id, title from books where {_ALLOWED}")
def catalog_dedupe_none(s: SparkSession, d: str) -> DataFrame:
    return C.catalog(table(s, d, "books"), C.Policy(dedupe="none"))[0].select("id", "title")


@query("select id, title, authors from books where contains(lower(coalesce(title, '')), 'salt road')")
def catalog_search(s: SparkSession, d: str) -> DataFrame:
    return C.search_catalog(table(s, d, "books"), title="Salt Road").select("id", "title", "authors")


@query("select id, title from books where (contains(lower(coalesce(title, '')), 'index mill') or (contains(lower(coalesce(title, '')), 'index') and contains(lower(coalesce(title, '')), 'mill'))) and contains(lower(coalesce(language, '')), 'en')")
def catalog_search_multiword(s: SparkSession, d: str) -> DataFrame:
    return C.search_catalog(table(s, d, "books"), title="index mill", language="EN").select("id", "title")


@query(
    f"""with f as (select feed_id, try_cast(trim(text_no) as bigint) as id, type, issued, title, language, authors from catalog_feed where regexp_matches(trim(text_no), '^[+-]?\\d+$')),
k as (select *, row_number() over (partition by id order by feed_id) as n from f where {_ALLOWED}) select id, feed_id, title, issued from k where n = 1"""
)
def catalog_first_delivery(s: SparkSession, d: str) -> DataFrame:
    feed = table(s, d, "catalog_feed").withColumn("id", F.expr("try_cast(trim(text_no) as bigint)")).where("id is not null")
    return C.catalog(feed, C.Policy(dedupe="none"), order="feed_id")[0].select("id", "feed_id", "title", "issued")


@query(f"with m as ({_MAP}), w as (select distinct try_cast(trim(text_no) as bigint) as request_id from catalog_feed where regexp_matches(trim(text_no), '^[+-]?\\d+$')) select w.request_id, b.id, b.title from w left join m on m.id = w.request_id left join books b on b.id = m.canonical_id")
def catalog_canonical_record(s: SparkSession, d: str) -> DataFrame:
    kept, links = C.catalog(table(s, d, "books"))
    wanted = table(s, d, "catalog_feed").select(F.expr("try_cast(trim(text_no) as bigint)").alias("request_id")).where("request_id is not null").distinct()
    return C.canonical_records(wanted, links, kept).select("request_id", "id", "title")


@query("with f as (select id, title from books where contains(lower(coalesce(title, '')), 'mill')) select id, title, (select count(*) from f) as total, greatest((select count(*) from f) - 10, 0) as remaining from f order by id limit 10")
def catalog_page(s: SparkSession, d: str) -> DataFrame:
    return C.catalog_page(C.search_catalog(table(s, d, "books"), title="mill"), 10).select("id", "title", "total", "remaining")


@query("select id, title, authors from books where id = 11")
def book_by_id(s: SparkSession, d: str) -> DataFrame:
    return R.book(table(s, d, "books"), 11).select("id", "title", "authors")


@query("select book_id, string_agg(content, E'\\n\\n' order by position, id) as content from chunks where book_id = 11 and content is not null group by 1")
def text_by_id(s: SparkSession, d: str) -> DataFrame:
    return R.text_of(table(s, d, "chunks"), 11)


@query(f"select id, struct_extract(k, 't') as title, struct_extract(k, 'a') as author from (select id, case when {_of(_WORK, 'title')} <> '' and {_of(_WORK, _AUTHOR)} <> '' then struct_pack(t := {_of(_WORK, 'title')}, a := {_of(_WORK, _AUTHOR)}) end as k from books)")
def work_key_pairs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "books").select("id", X.work_key("title", "authors").alias("k")).select("id", "k.title", "k.author")


@query(
    f"""with m as ({_MAP}), w as (select row_number() over (order by feed_id) as request_pos, try_cast(trim(text_no) as bigint) as id from catalog_feed
where regexp_matches(trim(text_no), '^[+-]?\\d+$')), j as (select w.request_pos, w.id, m.canonical_id from w left join m on m.id = w.id)
select status, count(*) as n from (select case when canonical_id is null then 'missing' when request_pos = min(request_pos) over (partition by canonical_id) then 'requested' else 'duplicate_requested' end as status from j) group by 1"""
)
def request_statuses(s: SparkSession, d: str) -> DataFrame:
    links = C.canonical_map(table(s, d, "books").where(C.allowed(EN)))
    wanted = table(s, d, "catalog_feed").select(F.col("feed_id").alias("request_pos"), F.expr("try_cast(trim(text_no) as bigint)").alias("id")).where("id is not null")
    return C.requests(wanted, links).groupBy("status").agg(F.count("*").alias("n"))


@query(
    r"""select id, array_to_string(list_filter(list_transform(string_split(coalesce(subjects, ''), ';'), lambda x: """
    + _of(_LINE, "x")
    + r"""), lambda x: x <> ''), '|') as items from books"""
)
def split_list(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "books").select("id", F.array_join(X.split_list("subjects"), "|").alias("items"))


@query(f"select id, {_of(_WORK, 'title')} as title_key, {_AUTHOR} as author from books")
def work_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "books").select("id", X.work_text("title").alias("title_key"), X.primary_author("authors").alias("author"))


# ---- store
@query(f"select b.id, b.title from books b left join texts t on t.book_id = b.id where t.book_id is null or coalesce(t.chunker_version, 1) <> {VERSION}")
def stale_books(s: SparkSession, d: str) -> DataFrame:
    return R.stale_books(table(s, d, "books"), table(s, d, "texts"), VERSION).select("id", "title")


@query(f"select b.id, t.book_id is not null as has_text, coalesce(coalesce(t.chunker_version, case when t.book_id is null then null else 1 end) = {VERSION}, false) as has_current_text from books b left join texts t on t.book_id = b.id")
def text_states(s: SparkSession, d: str) -> DataFrame:
    return R.text_states(table(s, d, "books"), table(s, d, "texts"), VERSION)


@query("select c.* from chunks c where not exists (select 1 from chunks x where x.book_id = c.book_id and x.position = c.position and x.id > c.id)")
def current_chunks(s: SparkSession, d: str) -> DataFrame:
    return R.current_chunks(table(s, d, "chunks"))


@query("select book_id, string_agg(content, E'\\n\\n' order by position, id) as content from (select * from chunks where content is not null) group by book_id union all select book_id, '' from chunks group by book_id having count(content) = 0")
def text_reconstruct(s: SparkSession, d: str) -> DataFrame:
    return R.reconstructed_texts(table(s, d, "chunks"))


@query("select id, book_id, position, content from chunks where kind = 'heading' and book_id = 11")
def chunk_records_kind(s: SparkSession, d: str) -> DataFrame:
    return R.chunk_records(table(s, d, "chunks"), 11, ["heading"]).select("id", "book_id", "position", "content")


@query("select id, book_id, position, content from chunks where book_id = 11 and position = 12")
def chunk_by_position(s: SparkSession, d: str) -> DataFrame:
    return R.chunk_by_position(table(s, d, "chunks"), 11, 12).select("id", "book_id", "position", "content")


@query("select h.book_id, h.position as centre, c.position, c.id from (select distinct book_id, position from chunks where kind = 'heading') h join chunks c on c.book_id = h.book_id and c.position between greatest(h.position - 2, 0) and h.position + 2")
def chunk_window(s: SparkSession, d: str) -> DataFrame:
    chunks = table(s, d, "chunks")
    centres = chunks.where("kind = 'heading'").select("book_id", F.col("position").alias("centre"))
    return R.chunk_windows(chunks, centres, 2).select("book_id", "centre", "position", "id")


_DIVSQL = f"with c as (select *, list_transform({_PARTS}, lambda x: {_of(_NORM, 'x')}) as p from chunks) select id, book_id, position from c where "


@query(_DIVSQL + "len(p) >= 1 and (p[1] = 'chapter i' or starts_with(p[1], 'chapter i '))")
def chunks_by_div(s: SparkSession, d: str) -> DataFrame:
    return R.chunks_by_div(table(s, d, "chunks"), " Chapter  I. ").select("id", "book_id", "position")


@query(_DIVSQL + "len(p) >= 2 and p[1] = 'book i' and (p[2] = 'chapter 2' or starts_with(p[2], 'chapter 2 ')) and kind = 'text'")
def chunks_by_div_nested(s: SparkSession, d: str) -> DataFrame:
    return R.chunks_by_div(table(s, d, "chunks"), "BOOK I / chapter 2", kinds=["text"]).select("id", "book_id", "position")


@query("select id, title from books where id not in (select book_id from texts where book_id is not null)")
def remove_books(s: SparkSession, d: str) -> DataFrame:
    return R.remove(table(s, d, "books").select("id", "title"), table(s, d, "texts").select(F.col("book_id").alias("id")), "id")


_FEED = "select * from (select try_cast(trim(text_no) as bigint) as id, title, authors, row_number() over (partition by try_cast(trim(text_no) as bigint) order by feed_id desc) as rn from catalog_feed where regexp_matches(trim(text_no), '^[+-]?\\d+$')) where rn = 1"


@query(f"with f as ({_FEED}) select id, title, authors from books where id not in (select id from f) union all select id, title, authors from f")
def upsert_books(s: SparkSession, d: str) -> DataFrame:
    feed = table(s, d, "catalog_feed").withColumn("id", F.expr("try_cast(trim(text_no) as bigint)")).where("id is not null")
    new = feed.groupBy("id").agg(F.max_by(F.struct("title", "authors"), "feed_id").alias("r")).select("id", "r.title", "r.authors")
    return R.upsert(table(s, d, "books").select("id", "title", "authors"), new, "id")


# ---- sections
_NUMBERED = "select *, sum(case when kind = 'heading' then 1 else 0 end) over (partition by book_id order by position, id rows unbounded preceding) as section_number from chunks"
_OWN = _of(_LINE, "coalesce(content, '')")
_LABEL = f"case when {_PATH} <> '' then {_PATH} when {_OWN} <> '' then {_OWN} else '(untitled section)' end"
_SECTIONS = f"""n as ({_NUMBERED}), h as (select book_id, section_number, {_LABEL} as section, position from n where kind = 'heading'),
st as (select book_id, section_number, count(*) filter (kind = 'text') as paras, cast(coalesce(sum(char_count) filter (kind = 'text'), 0) as bigint) as chars from n where section_number > 0 group by 1, 2),
sec as (select h.book_id, cast(h.section_number as bigint) as section_number, section, cast(position as bigint) as position, len(string_split(section, ' / ')) as depth, paras, chars from h join st using (book_id, section_number))"""


@query(f"with {_SECTIONS} select *, {_of(_WORDS, 'chars')} as est_words, {_of(_READ, _of(_WORDS, 'chars'))} as est_read from sec")
def section_summary(s: SparkSession, d: str) -> DataFrame:
    return S.section_rows(table(s, d, "chunks")).drop("opening_line")


_OPENINGS = f"""p as (select book_id, section_number, position, id, {_OWN} as line from n where kind = 'text' and section_number > 0 and {_OWN} <> ''),
l as (select book_id, section_number, list(line order by position, id)[1:4] as p from p group by 1, 2),
t as (select *, coalesce(list_position(list_transform(p, lambda x: {_of(_TITLE, 'x')}), false), 0) as body from l),
op as (select book_id, section_number, case when body > 2 or (body = 2 and p[1] like '%:') then p[body] else p[1] end as opening_line from t)"""


@query(f"with {_SECTIONS}, {_OPENINGS} select book_id, section_number, section, coalesce(opening_line, '') as opening_line from sec left join op using (book_id, section_number)")
def section_openings(s: SparkSession, d: str) -> DataFrame:
    return S.section_rows(table(s, d, "chunks")).select("book_id", "section_number", "section", "opening_line")


@query(
    f"""with o as (select book_id, count(*) as chunks_total, count(*) filter (kind = 'heading') as sections_total, count(*) filter (kind = 'text') as paragraphs_total,
cast(coalesce(sum(char_count), 0) as bigint) as chars_total, cast(max(case when {_PATH} = '' then 0 else len(string_split({_PATH}, ' / ')) end) as bigint) as levels_total from chunks group by 1)
select *, {_of(_WORDS, 'chars_total')} as est_words, {_of(_READ, _of(_WORDS, 'chars_total'))} as est_read from o"""
)
def toc_overview(s: SparkSession, d: str) -> DataFrame:
    return S.overview(table(s, d, "chunks"))


def _toc_sql(depth: int) -> str:
    p = lambda k: f"array_to_string(list_slice(string_split(section, ' / '), 1, {k}), ' / ')"
    near = [f"max(case when depth = {k} then section_number end) over (partition by book_id, {p(k)} order by section_number rows unbounded preceding)" for k in range(1, depth + 1)]
    owner = f"case when depth <= {depth} then section_number else greatest({', '.join(near)}) end" if depth > 1 else f"case when depth <= 1 then section_number else {near[0]} end"
    return f"""with {_SECTIONS}, o as (select *, {owner} as owner from sec),
r as (select book_id, owner as section_number, max(section) filter (owner = section_number) as section, max(position) filter (owner = section_number) as position, max(depth) filter (owner = section_number) as depth,
cast(sum(paras) as bigint) as paras, cast(sum(chars) as bigint) as chars from o where owner is not null group by 1, 2)
select *, {_of(_WORDS, 'chars')} as est_words, {_of(_READ, _of(_WORDS, 'chars'))} as est_read from r"""


@query(_toc_sql(1))
def toc_expand_1(s: SparkSession, d: str) -> DataFrame:
    return S.rolled_up(S.section_rows(table(s, d, "chunks")), 1).drop("opening_line")


@query(_toc_sql(2))
def toc_expand_2(s: SparkSession, d: str) -> DataFrame:
    return S.rolled_up(S.section_rows(table(s, d, "chunks")), 2).drop("opening_line")


@query(f"with {_SECTIONS} select book_id, section, max(section_number) as section_number from sec group by 1, 2")
def section_number_lookup(s: SparkSession, d: str) -> DataFrame:
    return S.section_numbers(S.section_rows(table(s, d, "chunks")))


@query(f"""with {_SECTIONS} select a.book_id, a.section_number, min(b.section_number) as visible_number from sec a join sec b on b.book_id = a.book_id and b.depth = 1 and b.section = string_split(a.section, ' / ')[1] group by 1, 2""")
def visible_section_numbers(s: SparkSession, d: str) -> DataFrame:
    return S.with_visible_number(S.section_rows(table(s, d, "chunks")), 1)


@query(f"""with {_SECTIONS} select section from sec where book_id = (select min(book_id) from sec where section_number = 2) and section_number = 2""")
def section_path_by_number(s: SparkSession, d: str) -> DataFrame:
    rows = S.section_rows(table(s, d, "chunks"))
    book = rows.where("section_number = 2").agg(F.min("book_id").alias("b")).first()["b"]
    return s.createDataFrame([(S.section_path_of(rows, book, 2),)], "section string")


_WORDSQL = "regexp_extract_all(coalesce(content, ''), '[A-Za-z]+(?:[\\x{27}’][A-Za-z]+)*')"
_STOPSQL = ", ".join(f"'{w}'" for w in X.STOPWORDS)


@query(
    f"""with w as (select book_id, position, id, {_WORDSQL} as t from chunks where kind = 'text'),
g as (select *, list_filter(t, lambda x: length(x) >= 4 and lower(x) not in ({_STOPSQL}))[1] as good, t[1] as one from w),
a as (select book_id, arg_min(good, (position, id)) filter (good is not null) as good, arg_min(one, (position, id)) filter (one is not null) as one from g group by 1)
select b.book_id, coalesce(good, one, 'chapter') as word from (select distinct book_id from chunks) b left join a on a.book_id = b.book_id"""
)
def search_words(s: SparkSession, d: str) -> DataFrame:
    return S.search_words(table(s, d, "chunks"))


@query("select book_id, id, position from (select *, row_number() over (partition by book_id order by position, id) as rn from chunks where position >= 3) where rn <= 5")
def view_forward(s: SparkSession, d: str) -> DataFrame:
    chunks = table(s, d, "chunks")
    return S.forward(chunks, chunks.select("book_id").distinct().withColumn("start", F.lit(3)), 5).select("book_id", "id", "position")


@query("select book_id, id, position from (select *, sum(case when kind = 'text' then 1 else 0 end) over (partition by book_id order by position, id rows unbounded preceding) as r from chunks where position >= 3) where r - case when kind = 'text' then 1 else 0 end < 4")
def section_reading_window(s: SparkSession, d: str) -> DataFrame:
    chunks = table(s, d, "chunks")
    return S.reading_window(chunks, chunks.select("book_id").distinct().withColumn("start", F.lit(3)), 4).select("book_id", "id", "position")


_FRONTSQL = ", ".join("'" + w.replace("'", "''") + "'" for w in S.FRONT_MATTER)


@query(
    f"""with h as (select c.book_id, c.position, lower({_OWN}) as flat, lower({_of(_LINE, "coalesce(b.title, '')")}) as title from chunks c left join books b on b.id = c.book_id where kind = 'heading'),
s as (select book_id, min(position) as start from h where not (flat in ({_FRONTSQL}) or starts_with(flat, 'by ') or (length(flat) >= 3 and (starts_with(title, flat) or (length(title) >= 3 and starts_with(flat, title))))) group by 1),
r as (select c.*, row_number() over (partition by c.book_id order by position, id) as n from chunks c left join s on s.book_id = c.book_id where position >= coalesce(start, 0)),
f as (select book_id, min(position) as body from r where kind <> 'heading' group by 1)
select r.book_id, id, position from r left join f on f.book_id = r.book_id where n <= 3 or position <= body"""
)
def opening_window(s: SparkSession, d: str) -> DataFrame:
    return S.opening_window(table(s, d, "chunks"), table(s, d, "books"), 3).select("book_id", "id", "position")


@query(f"select id, {_of(_WORDS, 'char_count')} as est_words, {_of(_READ, _of(_WORDS, 'char_count'))} as est_read from chunks")
def read_time(s: SparkSession, d: str) -> DataFrame:
    w = X.est_words("char_count")
    return table(s, d, "chunks").select("id", w.alias("est_words"), X.read_time(w).alias("est_read"))


# ---- full text
_TOKENS = r"tok as (select book_id, position, id, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(content, ''))), '[^\p{L}\p{N}\p{Co}]+'), lambda x: x <> '') as t from chunks), st as (select count(*) as n, avg(len(t)) as m from tok)"


def _leaf(words: str) -> str:
    """SQL of the places where the words stand in a row; a star ends a prefix, a caret allows only the first place."""
    last, words = "least(len(t) + 1, 2)" if words[0] == "^" else "len(t) + 1", words.lstrip("^")
    tests = [f"starts_with(t[i + {k}], '{w[:-1]}')" if w.endswith("*") else f"t[i + {k}] = '{w}'" for k, w in enumerate(words.split())]
    return f"list_filter(range(1, {last}), lambda i: {' and '.join(tests)})"


def _search_sql(leaves: list[str], where: str, tfs: list[str] | None = None, tail: str = "") -> str:
    """`where` and `tfs` name the leaves' places p0, p1 ..."""
    p = ", ".join(f"{_leaf(x)} as p{i}" for i, x in enumerate(leaves))
    df = ", ".join(f"(select count(*) from lv where len(p{i}) > 0) as d{i}" for i in range(len(leaves)))
    tfs = tfs or [f"len(p{i})" for i in range(len(leaves))]
    score = " + ".join(f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len(t) / m))" for i, tf in enumerate(tfs))
    return f"with {_TOKENS}, lv as (select *, {p} from tok), df as (select {df}), found as (select book_id, position, id, round({score}, 4) as score from lv, st, df where {where}) select {tail or '* from found'}"


def _index(s: SparkSession, d: str, stemmed: bool = False) -> T.Index:
    """The index of the chunks in `d`, built by the first search in the shared folder and read by all others while the table stays as it is."""
    folder = f"{checkpoint_dir(s)}/search/{state(s, f'{d}/chunks.parquet')}{'-stemmed' if stemmed else ''}"
    return T.Index.kept(table(s, d, "chunks"), folder, stemmed)


def _search(name: str, text: str, mode: str, sql: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        return T.hits(_index(s, d), text, mode).select("book_id", "position", "id", F.round("score", 4).alias("score"))

    run.__name__ = name
    query(sql)(run)


_search("search_auto_and", "dark Harbour", "auto", _search_sql(["dark", "harbour"], "len(p0) > 0 and len(p1) > 0"))
_search("search_phrase", "the dark", "phrase", _search_sql(["the dark"], "len(p0) > 0"))
_search("search_or", "harbour OR lantern", "raw", _search_sql(["harbour", "lantern"], "len(p0) > 0 or len(p1) > 0"))
_search("search_not", "harbour NOT dark", "raw", _search_sql(["harbour", "dark"], "len(p0) > 0 and len(p1) = 0"))
_search("search_prefix", "lant*", "raw", _search_sql(["lant*"], "len(p0) > 0"))
_search("search_group", "(harbour OR lantern) AND dark", "raw", _search_sql(["harbour", "lantern", "dark"], "(len(p0) > 0 or len(p1) > 0) and len(p2) > 0"))
_search("search_initial", "^nobody", "raw", _search_sql(["^nobody"], "len(p0) > 0"))
_near = lambda a, b: f"list_filter({a}, lambda x: len(list_filter({b}, lambda y: abs(x - y) - 1 <= 5)) > 0)"
_search("search_near", "NEAR(dark harbour, 5)", "raw", _search_sql(["dark", "harbour"], f"len({_near('p0', 'p1')}) > 0", [f"len({_near('p0', 'p1')})", f"len({_near('p1', 'p0')})"]))


def _found(s: SparkSession, d: str, **filters) -> DataFrame:
    return T.search(_index(s, d), table(s, d, "chunks"), table(s, d, "books"), "harbour", **filters)


_HARBOUR = _search_sql(["harbour"], "len(p0) > 0", None, "{}")
_JOINED = "from found join chunks c using (book_id, position, id) join books b on b.id = found.book_id"


@query(_HARBOUR.replace("{}", f"row_number() over (order by score desc, found.book_id, found.position, found.id) as rank, found.book_id, found.position, found.id, score {_JOINED} order by rank limit 50"))
def search_bm25_rank(s: SparkSession, d: str) -> DataFrame:
    return T.ranked(_found(s, d).withColumn("score", F.round("score", 4)), "rank", 50).select("rank", "book_id", "position", "id", "score")


@query(_HARBOUR.replace("{}", f"found.book_id, found.position, found.id {_JOINED} order by found.book_id, found.position, found.id limit 50"))
def search_order_first(s: SparkSession, d: str) -> DataFrame:
    return T.ordered(_found(s, d), "first", 50).select("book_id", "position", "id")


@query(_HARBOUR.replace("{}", f"found.book_id, found.position, found.id {_JOINED} order by found.book_id desc, found.position desc, found.id limit 50"))
def search_order_last(s: SparkSession, d: str) -> DataFrame:
    return T.ordered(_found(s, d), "last", 50).select("book_id", "position", "id")


@query(_HARBOUR.replace("{}", f"found.id, title, score {_JOINED} where kind = 'text' and lower(coalesce(b.title, '')) like '%mill%' and lower(coalesce(b.language, '')) like '%en%'"))
def search_filters(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d, kind="text", title="Mill", language="en").select("id", "title", F.round("score", 4).alias("score"))


@query(_HARBOUR.replace("{}", f"count(*) as n {_JOINED}"))
def search_count(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d).agg(F.count("*").alias("n"))


@query(_HARBOUR.replace("{}", f"found.id, score {_JOINED} where found.book_id in (11, 12, 13)"))
def search_book_ids(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d, book_ids=[11, 12, 13]).select("id", F.round("score", 4).alias("score"))


_SECTION = f"list_transform({_PARTS}, lambda x: {_of(_NORM, 'x')})"


@query(_HARBOUR.replace("{}", f"id, score from (select found.id, score, {_SECTION} as p {_JOINED}) where len(p) >= 1 and (p[1] = 'chapter ii' or starts_with(p[1], 'chapter ii '))"))
def search_section(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d, section="chapter ii").select("id", F.round("score", 4).alias("score"))


@query(_HARBOUR.replace("{}", f"count(*) as n from (select found.id, {_SECTION} as p {_JOINED}) where len(p) >= 1 and (p[1] = 'chapter ii' or starts_with(p[1], 'chapter ii '))"))
def search_section_count(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d, section="chapter ii").agg(F.count("*").alias("n"))


@query(_HARBOUR.replace("{}", "h.book_id, h.position, string_agg(c.content, E'\\n\\n' order by c.position, c.id) as passage from (select distinct book_id, position from found) h join chunks c on c.book_id = h.book_id and c.position between h.position - 1 and h.position + 1 group by 1, 2"))
def search_context(s: SparkSession, d: str) -> DataFrame:
    return T.passages(T.hits(_index(s, d), "harbour"), table(s, d, "chunks"), 1)


@query()
def porter_search(s: SparkSession, d: str) -> DataFrame:
    return T.hits(_index(s, d, stemmed=True), "hesitates harbours").select("book_id", "position", "id", F.round("score", 4).alias("score"))


@query("with " + _TOKENS + " select u as term, count(*) as df from (select id, unnest(list_distinct(t)) as u from tok) group by 1")
def index_vocabulary(s: SparkSession, d: str) -> DataFrame:
    return _index(s, d).postings.groupBy("term").agg(F.count("*").alias("df"))


# ---- pages, ingest, answers
@query()
def html_chunks(s: SparkSession, d: str) -> DataFrame:
    from bookspark.html.chunker import chunk_books

    return chunk_books(table(s, d, "texts"), "book_id", "content")


def _rules_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [f"({quoted(name)}, {i}, {quoted(path)})" for name, (_, want) in PAGES.items() for i, path in enumerate(want, 1)]
    return f"select * from (values {', '.join(rows)}) as t(rule, n, path)"


@query(_rules_sql())
def chunker_rules(s: SparkSession, d: str) -> DataFrame:
    """Headings of the sample pages of each rule of the chunker, against the rows that the rules ask for."""
    from bookspark.html.chunker import chunk_books

    pages = s.createDataFrame([(name, page) for name, (page, _) in PAGES.items()], "rule string, html string")
    heads = chunk_books(pages, "rule").where("kind = 'heading'").withColumn("path", X.section_path(*S.DIVS))
    order = Window.partitionBy("rule").orderBy("position")
    return heads.select("rule", F.row_number().over(order).alias("n"), "path")


@query("select b.id, case when coalesce(t.chunker_version, case when t.book_id is null then null else 1 end) = 3 then 'skip' when t.book_id is not null then 'reprocess' else 'add' end as action from books b left join texts t on t.book_id = b.id")
def ingest_plan(s: SparkSession, d: str) -> DataFrame:
    from bookspark.operators.ingest import plan_ingest

    return plan_ingest(table(s, d, "books"), table(s, d, "texts"), version=VERSION)


@query("select id, s.source, s.priority, s.before || id::varchar || s.after as url from books, (values ('mirror', 1, 'https://mirror.example/', '.html'), ('zip', 2, 'https://main.example/', '-h.zip')) s(source, priority, before, after)")
def page_candidates(s: SparkSession, d: str) -> DataFrame:
    from bookspark.sources.pages import Source, candidates

    return candidates(table(s, d, "books"), [Source("mirror", "https://mirror.example/{id}.html", 1), Source("zip", "https://main.example/{id}-h.zip", 2)])


BASE = "https://books.example/ebooks"
_FIELDS = ", ".join(f"{c} := {_of(_LINE, f"coalesce({c}, '')")}" for c in ("title", "authors", "language", "subjects", "locc", "bookshelves", "issued", "type"))


@query(f"select id, cast(to_json(struct_pack(id := id, {_FIELDS}, link := '{BASE}/' || id::varchar)) as varchar) as payload from books")
def book_payloads(s: SparkSession, d: str) -> DataFrame:
    from bookspark.plans.payload import book_payloads as payloads

    return payloads(table(s, d, "books"), BASE)


@query(f"select c.book_id, cast(c.position as bigint) as position, cast(to_json(struct_pack(book_id := c.book_id, title := null, author := null, section := {_PATH}, section_number := null, position := cast(c.position as bigint), forward := null, radius := null, \"all\" := null, link := '{BASE}/' || c.book_id::varchar, content := c.content)) as varchar) as payload from chunks c where kind = 'heading'")
def passage_payloads(s: SparkSession, d: str) -> DataFrame:
    from bookspark.plans.payload import passage_payloads as payloads

    heads = table(s, d, "chunks").where("kind = 'heading'")
    return payloads(heads.select("book_id", F.col("position").cast("bigint").alias("position"), X.section_path(*S.DIVS).alias("section"), "content"), BASE)


@query()
def section_payloads(s: SparkSession, d: str) -> DataFrame:
    from bookspark.plans.payload import section_payloads as payloads

    return payloads(S.section_rows(table(s, d, "chunks")))


@query("select id, case when length(content) > 60 then replace(left(content, 60), chr(10), ' ') || '…' else replace(content, chr(10), ' ') end as shown from chunks")
def previews(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("id", X.preview("content", 60).alias("shown"))


@query(f"select id, {_of(_TITLE, _of(_LINE, 'content'))} as title_like from chunks")
def title_like_headings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("id", X.title_like("content").alias("title_like"))


@query("select count(*) as records, strftime(received_at, '%Y-%m-%d') as day from catalog_feed where received_at is not null group by 2")
def feed_by_day(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "catalog_feed").where("received_at is not null").groupBy(F.date_format("received_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("records"))
