import gzip
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from bookspark.functions import text as X
from bookspark.functions.porter import stem
from bookspark.functions.query import QuerySyntaxError, auto_query, parse_query
from bookspark.operators import catalog as C
from bookspark.operators import fulltext as T
from bookspark.operators import sections as S
from bookspark.operators import store as R
from bookspark.operators.ingest import ingest
from bookspark.operators.scan import running_max, running_sum
from bookspark.plans import payload
from bookspark.sources import pages as P

TEXTS = ["the dark harbour lay still", "A harbour, a lantern and the dark sea.", "Lanterns in the dark lane; the dark lane", None, "", "ships of the harbour walked on walking", "the the the dark", "philosophy and philosophers", "dark one two three harbour", "harbour one two three four five six seven eight nine ten eleven dark"]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, 1 + i % 2, i, t) for i, t in enumerate(TEXTS)], "id bigint, book_id bigint, position int, content string").cache()


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(content, tokenize='porter unicode61')")
    con.execute("create virtual table g using fts5(content, tokenize='unicode61')")
    for t in "fg":
        con.executemany(f"insert into {t}(rowid, content) values (?, ?)", [(i, t_ or "") for i, t_ in enumerate(TEXTS)])
    return con


RAW = ["harbour", "dark harbour", '"the dark"', "harbour OR lantern", "dark NOT harbour", "philos*", '"the da" *', "NEAR(dark harbour, 3)", "NEAR(dark harbour)", "^the", "(harbour OR lantern) AND dark", "lantern OR dark NOT harbour", "the + dark", "content: dark", '"..."', "NEAR(the dark lane, 2)"]


@pytest.mark.parametrize("query", RAW)
@pytest.mark.parametrize("stemmed", [False, True])
def test_search_like_a_second_engine(spark, chunks, fts, query, stemmed):
    got = {r["id"]: r["score"] for r in T.hits(T.build_index(chunks, stemmed), query, "raw").collect()}
    want = {i: -s for i, s in fts.execute(f"select rowid, rank from {'f' if stemmed else 'g'} where content match ?", (query,)).fetchall()} if ":" not in query else {i: -s for i, s in fts.execute(f"select rowid, rank from {'f' if stemmed else 'g'} where {'f' if stemmed else 'g'} match ?", (query,)).fetchall()}
    assert set(got) == set(want)
    assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


@pytest.mark.parametrize("query", ["", "AND a", "a AND", "NOT a", '"open', "(a OR b) c", "half-hour", "it's", "author: x", "(a", "NEAR(a b, x)"])
def test_malformed_queries(query):
    with pytest.raises(QuerySyntaxError):
        parse_query(query)


def test_auto_mode_and_blank_query(chunks):
    assert auto_query('half-hour "x') == '"half-hour" """x"'
    with pytest.raises(ValueError):
        T.hits(T.build_index(chunks), "  ")


def test_stemmer():
    assert [stem(w) for w in "caresses ponies cats agreed plastered motoring hopping filing happy relational conditional vietnamization triplicate hopefulness revival adjustment probate rate controll".split()] == "caress poni cat agre plaster motor hop file happi relat condit vietnam triplic hope reviv adjust probat rate control".split()


def test_index_round_trip(spark, chunks, tmp_path):
    T.build_index(chunks).write(str(tmp_path / "ix"))
    assert T.hits(T.Index.read(spark, str(tmp_path / "ix")), "lantern").count() == 1


def test_page_orders_and_filters(spark, chunks):
    books = spark.createDataFrame([(1, "Mill 100%", "A", "en", ""), (2, "Bridge", None, None, None)], "id bigint, title string, authors string, language string, subjects string")
    full = chunks.withColumns({"kind": F.lit("text"), "div1": F.lit("Chapter I"), "div2": F.lit(None).cast("string"), "div3": F.lit(""), "div4": F.lit("")})
    found = T.search(T.build_index(chunks), full, books, "harbour")
    rows, total = T.page(found, "first", 2)
    assert len(rows) == 2 and total == found.count()
    assert T.page(found, "rank", -1)[0] == []
    assert T.search(T.build_index(chunks), full, books, "harbour", title="m_LL 1").count() == found.where("book_id = 1").count()
    assert T.search(T.build_index(chunks), full, books, "harbour", book_ids=[]).count() == 0
    assert T.search(T.build_index(chunks), full, books, "harbour", section="chapter  i.").count() == total
    with pytest.raises(ValueError):
        T.ordered(found, "sideways")


def test_running_sum_over_blocks(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("p"))
    got = running_sum(df, "k", "p", F.lit(1), "n", block=7)
    assert got.where("n <> p + 1").count() == 0 and got.count() == 1000


SECTIONS = [(1, 0, "text", "", "", "before"), (1, 1, "heading", "BOOK I", "", "BOOK I"), (1, 2, "text", "BOOK I", "", "A TITLE"), (1, 3, "text", "BOOK I", "", "It began, at last."), (1, 4, "heading", "BOOK I", "Chapter 1", "Chapter 1"), (1, 5, "text", "BOOK I", "Chapter 1", "x" * 2600), (1, 6, "heading", "", "", "  odd\none "), (2, 0, "text", "", "", None), (3, 0, "heading", None, None, None)]


@pytest.fixture(scope="module")
def book_chunks(spark):
    rows = [(i, b, p, k, c, None if c is None else len(c), d1, d2, "", "") for i, (b, p, k, d1, d2, c) in enumerate(SECTIONS)]
    return spark.createDataFrame(rows, "id bigint, book_id bigint, position int, kind string, content string, char_count int, div1 string, div2 string, div3 string, div4 string").cache()


def test_running_max_over_blocks(spark):
    rows = [(k, p, (p * 7919) % 13 if p % 3 else None) for k in ("a", None) for p in range(30)]
    df = spark.createDataFrame(rows, "k string, p int, v int")
    got = {(r.k, r.p): r.m for r in running_max(df, ["k"], "p", F.col("v"), "m", block=4).collect()}
    for k in ("a", None):
        for p in range(30):
            assert got[k, p] == max((v for kk, q, v in rows if kk == k and q <= p and v is not None), default=None)


def test_sections(book_chunks):
    got = {(r.book_id, r.section_number): r for r in S.section_rows(book_chunks).collect()}
    assert [(k, got[k].section, got[k].paras, got[k].chars, got[k].est_read) for k in sorted(got)] == [((1, 1), "BOOK I", 2, 25, "1m"), ((1, 2), "BOOK I / Chapter 1", 1, 2600, "2m"), ((1, 3), "odd one", 0, 0, "n/a"), ((3, 1), "(untitled section)", 0, 0, "n/a")]
    assert got[1, 1].opening_line == "A TITLE"
    up = {r.section_number: r for r in S.rolled_up(S.section_rows(book_chunks), 1).where("book_id = 1").collect()}
    assert sorted(up) == [1, 3] and up[1].paras == 3 and up[1].chars == 2625
    assert S.rolled_up(S.section_rows(book_chunks), 4).count() == 4


def test_reading_windows(spark, book_chunks):
    at = spark.createDataFrame([(1, 1)], "book_id bigint, start int")
    places = lambda df: sorted(r.position for r in df.collect())
    assert places(S.reading_window(book_chunks, at, 2)) == [1, 2, 3]
    assert places(S.reading_window(book_chunks, at, 3)) == [1, 2, 3, 4, 5]
    assert places(S.reading_window(book_chunks, at, 0)) == []
    assert places(S.forward(book_chunks, at, 2)) == [1, 2]
    books = spark.createDataFrame([(1, "Book I and more"), (2, None)], "id bigint, title string")
    assert places(S.opening_window(book_chunks, books, 1).where("book_id = 1")) == [4, 5]


def test_section_paths(book_chunks):
    n = lambda p, **k: R.chunks_by_div(book_chunks, p, **k).count()
    assert n("book i") == 5 and n("book I / chapter") == 2 and n("boo") == 0 and n("/") == len(SECTIONS) and n("book i", limit=2) == 2
    with pytest.raises(ValueError):
        R.path_segments("a/b/c/d/e")


def test_windows_and_states(spark, book_chunks):
    centres = spark.createDataFrame([(1, 1), (1, 99), (9, 0)], "book_id bigint, centre int")
    assert sorted(r.position for r in R.chunk_windows(book_chunks, centres, 1).collect()) == [0, 1, 2]
    texts = spark.createDataFrame([(1, 1), (2, None)], "book_id bigint, chunker_version int")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    assert {tuple(r) for r in R.text_states(ids, texts, 1).collect()} == {(1, True, True), (2, True, True), (3, False, False)}


def test_catalog(spark, tmp_path):
    head = "Text#,Type,Issued,Title,Language,Authors,Subjects,LoCC,Bookshelves\n"
    body = '7,Text,2001,"The Mill\nof X",en,"Reed, A. [Editor]; Hill, B",S,L,B\n3,text ,2001,The Mill of X!,"fr; en","Reed, A.",S,L,B\nx,Text,,No,en,,,,\n9,Sound,,S,en,,,,\n8,Text,,F,fr,,,,\n5,Text,,,en,,,,\n'
    path = tmp_path / "c.csv.gz"
    path.write_bytes(gzip.compress((head + body).encode()))
    records = C.read_catalog(spark, str(path))
    assert records.count() == 5
    kept, links = C.catalog(records)
    assert sorted(r.id for r in kept.collect()) == [3, 5]
    assert {tuple(r) for r in links.collect()} == {(3, 3), (7, 3), (5, 5)}
    assert C.catalog(records, C.Policy(dedupe="none"))[0].count() == 3
    assert [r.id for r in C.search_catalog(records, title="x mill").collect()] == [3, 7]
    wanted = spark.createDataFrame([(1, 7), (2, 3), (3, 44)], "request_pos int, id bigint")
    assert [r.status for r in C.requests(wanted, links).orderBy("request_pos").collect()] == ["requested", "duplicate_requested", "missing"]
    empty = records.limit(0)
    assert C.catalog(empty)[0].count() == 0


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(X.read_time(F.lit(625))) == "2m" and one(X.read_time(F.lit(20_000))) == "1h 20m"
    assert one(X.preview(F.lit("abc\ndef"), 4)) == "abc …"
    assert one(X.split_list(F.lit(" a ;; b  c;"))) == ["a", "b c"]
    assert one(X.summarize_list(F.lit("a;b;c"), 2)) == "a; b; +1 more"
    assert one(X.primary_author(F.lit("Reed, A. (x) [Editor]; B"))) == "Reed, A."
    assert one(X.normal_segment(F.lit("  The  End , of it !?”"))) == "the end,of it"
    assert one(X.opening_line(F.array(F.lit("THE BELL"), F.lit("Chapter I"), F.lit("It rang out, once.")))) == "It rang out, once."
    assert one(X.words_to_search(F.lit("After the lanterns"))).asDict() == {"good": "lanterns", "first": "After"} and one(X.words_to_search(F.lit("1 2")))["first"] is None
    assert one(X.tokens(F.lit("Été, näive!"))) == ["ete", "naive"]
    assert one(X.title_like(F.lit("The Bells of York"))) is True and one(X.title_like(F.lit("He ran."))) is False


def test_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "12-h.zip", "w") as z:
        z.writestr("a/z.htm", "no")
        z.writestr("a/pg12-images.html", "﻿<p>yes</p>")
    (tmp_path / "13.zip").write_bytes(b"junk")
    got = {r.id: r for r in P.read_pages(spark, str(tmp_path)).collect()}
    assert got[12].html == "<p>yes</p>" and got[13].html is None and "BadZipFile" in got[13].error
    answers = spark.createDataFrame([(1, "a", 1, None, "404"), (1, "b", 2, "<p>", None)], "id bigint, source string, priority int, html string, error string")
    assert P.first_answer(answers).first()["source"] == "b"
    assert [P.catalog_source(*x) for x in ((True, True, False, False), (True, False, False, False), (False, False, True, True))] == ["cache", "stale_cache", "downloaded"]
    with pytest.raises(OSError):
        P.catalog_source(True, True, True, False)
    assert P.cache_age(tmp_path / "none") is None


PAGE = """<html><body><section id="pg-header"><div>*** START OF THIS EBOOK: T ***</div></section><h1>The Bells</h1>
<p class="toc"><a class="pginternal" href="#a">CHAPTER I</a> <a class="pginternal" href="#b">CHAPTER II</a></p>
<h2><a id="a"></a>CHAPTER I</h2><h3>The Start</h3><p>One<span class="pagenum">[Pg 3]</span> line.<p>Two<br>lines.
<h2 id="b">CHAPTER II</h2><pre>verse
  more
</pre><p>End.</p><section id="pg-footer"><div>*** END OF THIS EBOOK ***</div><p>licence</p></section></body></html>"""


def test_chunker_and_ingest(spark, tmp_path):
    from bookspark.html.chunker import chunk_html

    rows = chunk_html(PAGE)
    assert [(r[0], r[1], r[5], r[6]) for r in rows] == [
        (0, "CHAPTER I The Start", "CHAPTER I The Start", "heading"),
        (1, "CHAPTER I The Start", "One line.", "text"),
        (2, "CHAPTER I The Start", "Two lines.", "text"),
        (3, "CHAPTER II", "CHAPTER II", "heading"),
        (4, "CHAPTER II", "verse\n  more", "text"),
        (5, "CHAPTER II", "End.", "text"),
    ]
    assert chunk_html("") == [] and chunk_html("<p>a</p>") == []
    flat = "".join(f"<p>Paragraph number {i}.</p>" for i in range(12))
    assert len(chunk_html(flat)) == 12
    nested = "".join(f"<h2>{h}</h2><p>{'text ' * 9}</p>" for h in ("PART I", "BOOK I", "Chapter 1", "Chapter 2", "PART II", "BOOK I", "Chapter 1"))
    assert [(r[1], r[2], r[3]) for r in chunk_html(nested) if r[6] == "heading"][3] == ("PART I", "BOOK I", "Chapter 2")
    store = R.Store(spark, str(tmp_path / "store"))
    books = spark.createDataFrame([(1, "T"), (2, "U")], "id bigint, title string")
    pages = spark.createDataFrame([(1, PAGE)], "id bigint, html string")
    report = lambda f=False: {r.id: r.status for r in ingest(store, books, pages, f).collect()}
    assert report() == {1: "added", 2: "failed"}
    assert report() == {1: "skipped_current", 2: "failed"}
    assert report(True) == {1: "reprocessed", 2: "failed"}
    assert store.read("chunks").count() == 6 and store.read("texts").first()["content"].startswith("CHAPTER I")
    assert store.remove(books.where("id = 1")) and not store.remove(books.where("id = 1"))
    assert store.read("chunks").count() == 0


def test_store_writes_only_what_it_touches(spark, tmp_path):
    store = R.Store(spark, str(tmp_path / "store"), buckets=8)
    books = spark.createDataFrame([(i, f"T{i}") for i in range(40)], "id bigint, title string")
    texts = books.select(F.col("id").alias("book_id"), F.col("title").alias("content"))
    chunks = texts.withColumn("position", F.lit(0))
    assert store.read("books") is None and not store.remove(books)
    store.store(books, texts, chunks)
    before = store._manifest()["tables"]
    assert store.read("chunks").count() == 40 and len(before["chunks"]["parts"]) <= 8
    store.store(books.where("id = 3").withColumn("title", F.lit("new")), texts.where("book_id = 3"), chunks.where("book_id = 3"))
    after = store._manifest()["tables"]
    assert sum(before["books"]["parts"][b] != v for b, v in after["books"]["parts"].items()) == 1
    assert {r.title for r in store.read("books").where("id in (3, 4)").collect()} == {"new", "T4"} and store.read("books").count() == 40
    assert store.remove(books.where("id = 3")) and store.read("texts").count() == 39
    store.write(books=books.limit(0))
    assert store.read("books").count() == 0 and store.read("texts").count() == 39


def test_stream(spark, tmp_path):
    from bookspark.streaming.feed import FEED, deliveries_by_day, read_feed

    row = lambda i, day: (i, 20240101, day, "1", "Text", "", "", "", "", "", "", "")
    import datetime

    day = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([row(1, day), row(1, day), row(2, day + datetime.timedelta(days=1))], FEED).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = deliveries_by_day(read_feed(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.records for r in spark.table("days").collect()) == [1, 1]


def test_payloads(book_chunks):
    assert '"ok": false' in payload.envelope("search", errors=["x"])
    assert payload.search_filters(book_ids=[3])["book_id"] == 3
    assert "BOOK I" in payload.section_payloads(S.section_rows(book_chunks)).where("book_id = 1").first()["payload"]
    with pytest.raises(ValueError):
        payload.parse_book_ids("1 x")
