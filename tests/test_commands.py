import json

import pytest
from pyspark.sql import functions as F

from bookspark.operators import catalog as C
from bookspark.operators import fulltext as T
from bookspark.operators.store import Store
from bookspark.plans import commands as K
from bookspark.sources.tables import state

ROWS = [("heading", "BOOK I", "BOOK I", ""), ("text", "A dark harbour lay there.", "BOOK I", ""), ("heading", "Chapter 1", "BOOK I", "Chapter 1"), ("text", "The lantern, and the harbour.", "BOOK I", "Chapter 1"), ("text", "Nothing else.", "BOOK I", "Chapter 1"), ("heading", "BOOK II", "BOOK II", ""), ("text", "The harbour again.", "BOOK II", "")]
BOOK = "id bigint, title string, authors string, language string, subjects string, locc string, bookshelves string, issued string, type string"
PAGE = "<html><body><h2>CHAPTER I</h2><p>One line of text here.</p><h2>CHAPTER II</h2><p>Two lines of text here.</p></body></html>"


@pytest.fixture(scope="module")
def lib(spark):
    chunks = spark.createDataFrame([(i, 5, i, d1, d2, "", "", c, k, len(c)) for i, (k, c, d1, d2) in enumerate(ROWS)], "id bigint, book_id bigint, position int, div1 string, div2 string, div3 string, div4 string, content string, kind string, char_count int").cache()
    books = spark.createDataFrame([(5, "A  Title\nof two", "Night, Sam", "en", "", "", "", None, "Text")], BOOK).cache()
    texts = spark.createDataFrame([(5, "x", 1)], "book_id bigint, content string, chunker_version int")
    return K.Library(books, texts, chunks, T.build_index(chunks))


def answer(text):
    got = json.loads(text)
    return got["data"] if got["ok"] else got["errors"]


def test_search_command(lib):
    got = answer(K.search(lib, "harbour", order="first", limit=2, book_ids=[5]))
    assert got["total_results"] == 3 and got["shown_results"] == 2 and got["filters"]["book_id"] == 5
    assert [(x["rank"], x["position"], x["section"], x["section_number"], x["title"]) for x in got["items"]] == [(1, 1, "BOOK I", 1, "A Title of two"), (2, 3, "BOOK I / Chapter 1", 2, "A Title of two")]
    assert got["items"][0]["link"].endswith("/5") and got["items"][0]["radius"] is None and got["items"][0]["forward"] is None
    assert [x["position"] for x in answer(K.search(lib, "harbour", section="2", book_ids=[5]))["items"]] == [3]
    assert answer(K.search(lib, "harbour", count=True, section="book ii"))["count"] == 1
    assert "Chapter 1\n\nThe lantern" in answer(K.search(lib, "lantern", radius=1))["items"][0]["content"]
    both = json.loads(K.search(lib, "harbour", book_ids=[5, 77]))
    assert both["ok"] and both["warnings"] == ["Book 77 is not in the database."]


def test_search_errors(lib):
    bad = json.loads(K.search(lib, '"open', mode="raw", limit=3))
    assert not bad["ok"] and bad["errors"][0].startswith("Invalid query syntax") and bad["data"]["limit"] == 3 and bad["data"]["query"]["mode"] == "raw"
    for kwargs in ({"limit": 0}, {"radius": -1}, {"order": "x"}, {"section": "2"}, {"section": "9", "book_ids": [5]}, {"section": "a/b/c/d/e"}, {"section": "1", "book_ids": [6]}):
        assert not json.loads(K.search(lib, "harbour", **kwargs))["ok"], kwargs
    assert "out of range" in answer(K.search(lib, "x", section="9", book_ids=[5]))[0]


def test_toc_and_view(lib):
    got = answer(K.toc(lib, 5, "1"))
    assert [(s["section_number"], s["paras"]) for s in got["sections"]] == [(1, 3), (3, 1)] and got["try"] == "dark" and got["overview"]["sections_total"] == 3
    assert len(answer(K.toc(lib, 5, "all"))["sections"]) == 3
    assert answer(K.toc(lib, 9)) == ["Book 9 is not in the database."] and not json.loads(K.toc(lib, 5, "7"))["ok"]
    assert answer(K.view(lib, 5, section="2", forward=2))["content"] == "Chapter 1\n\nThe lantern, and the harbour.\n\nNothing else."
    assert answer(K.view(lib, 5, section="book i", all=True))["paragraphs"] == 3
    assert answer(K.view(lib, 5, position=4, radius=1))["content"].startswith("The lantern")
    assert answer(K.view(lib, 5, position=5, forward=2))["content"] == "BOOK II\n\nThe harbour again."
    assert answer(K.view(lib, 5, all=True))["paragraphs"] == 4 and answer(K.view(lib, 5))["position"] == 0
    for kwargs in ({"forward": 1, "all": True}, {"position": 1, "section": "x"}, {"forward": 0}, {"radius": 1}, {"position": 99}, {"section": "none such"}):
        assert not json.loads(K.view(lib, 5, **kwargs))["ok"], kwargs


def test_catalog_and_books(lib, spark):
    records = spark.createDataFrame([(i, f"Mill {i}", "A", "en", "", "", "", "", "Text") for i in range(5)], BOOK)
    got = answer(K.catalog(records, "https://b.example", title="mill", limit=2))
    assert (got["total_matches"], got["shown"], got["remaining"], [x["id"] for x in got["items"]]) == (5, 2, 3, [0, 1])
    assert not json.loads(K.catalog(records, "b", limit=0))["ok"]
    assert answer(K.books(lib, 1))["items"][0]["issued"] == ""
    assert answer(K.books(lib, 1, refresh=[5, 8]))["actions"] == {"reprocess": 1} and answer(K.books(lib, 1, refresh=[]))["actions"] == {"skip": 1}


def test_add_and_remove(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    records = spark.createDataFrame([(1, "T", "A", "en", "", "", "", "", "Text"), (2, "T", "A", "en", "", "", "", "", "Text"), (3, "U", "A", "fr", "", "", "", "", "Text"), (4, "V", "A", "en", "", "", "", "", "Text")], BOOK)
    pages = spark.createDataFrame([(1, PAGE)], "id bigint, html string")
    got = answer(K.add(store, records, pages, [2, 1, 3, 4]))
    assert [(x["id"], x["canonical_id"], x["status"]) for x in got["items"]] == [(2, 1, "added"), (1, 1, "duplicate_requested"), (3, None, "out_of_policy"), (4, 4, "failed")]
    assert answer(K.add(store, records, pages, [1]))["counts"] == {"skipped_current": 1}
    assert answer(K.add(store, records, pages, [3])) == ["no book was added"]
    gone = json.loads(K.remove(store, [1, 9]))
    assert not gone["ok"] and gone["data"] == {"removed": [1]} and store.read("chunks").count() == 0


def test_kept_index(lib, spark, tmp_path):
    lib.chunks.write.parquet(str(tmp_path / "chunks"))
    name = state(spark, str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    a = T.Index.kept(chunks, str(tmp_path / name))
    b = T.Index.kept(chunks.limit(0), str(tmp_path / name))  # read, not built again
    assert T.hits(a, "harbour").count() == T.hits(b, "harbour").count() == 3
    plan = b.postings.where(F.col("term").isin(["harbour"]))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,harbour)" in plan
    lib.chunks.limit(1).write.mode("overwrite").parquet(str(tmp_path / "chunks"))
    assert state(spark, str(tmp_path / "chunks")) != name
    assert [r["rank"] for r in T.ranked(T.search(b, lib.chunks, lib.books, "harbour"), "last", 2).collect()] == [1, 2]


def test_first_record_by_arrival(spark):
    rows = [(1, "Z", "A", "en", "", "", "", "", "Text", 1), (1, "B", "A", "en", "", "", "", "", "Text", 2), (1, "A", "A", "fr", "", "", "", "", "Text", 0)]
    kept, links = C.catalog(spark.createDataFrame(rows, BOOK + ", n int"), order="n")
    assert [r["title"] for r in kept.collect()] == ["Z"]
    wanted = spark.createDataFrame([(1,), (9,)], "request_id bigint")
    assert {r["request_id"]: r["title"] for r in C.canonical_records(wanted, links, kept).collect()} == {1: "Z", 9: None}
