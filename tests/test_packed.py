import pytest

from bookspark.operators import packed
from bookspark.operators.packed import parse, split_packed

SEEN = [(i, "Sea Stories; Lost Voyages; Harbour Life", "Night, Anne, 1801-1860; Reed, Carl, 1799-1850 [Editor]") for i in range(30)] + [(100 + i, '"Songs; Old and New"', "Hill, Ada, 1840-1900") for i in range(10)]


def items(spark, value, field="shelves"):
    rows = SEEN + [(999, value, None)] if field == "shelves" else SEEN + [(999, None, value)]
    df = spark.createDataFrame(rows, "id bigint, shelves string, names string")
    out = split_packed(df, "id", ["shelves", "names"]).where(f"id = 999 and field = '{field}'").orderBy("pos").collect()
    assert [r.pos for r in out] == list(range(1, len(out) + 1))
    return [r["item"] for r in out]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("Sea Stories | Harbour Life", ["Sea Stories", "Harbour Life"]),
        ("; Sea Stories;; Lost Voyages ;", ["Sea Stories", "Lost Voyages"]),
        ("Sea Stories, Lost Voyages", ["Sea Stories", "Lost Voyages"]),
        ('["Sea Stories", "Songs; Old and New"]', ["Sea Stories", "Songs; Old and New"]),
        ('"Sea Stories" / "Lost Voyages"\n"Harbour Life"', ["Sea Stories", "Lost Voyages", "Harbour Life"]),
        ("  Harbour Life ", ["Harbour Life"]),
    ],
)
def test_lists(spark, value, expected):
    assert items(spark, value) == expected


def test_a_name_with_commas_is_one_value(spark):
    assert items(spark, "Wood, Ida, 1820-1880", "names") == ["Wood, Ida, 1820-1880"]


def test_nulls_blanks_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "  ", "y"), (3, "", "z"), (4, "A; B", "w"), (4, "A; B", "w")], "id bigint, raw string, item string")
    got = sorted((r.id, r.field, r.pos, r["item"]) for r in split_packed(df.withColumnRenamed("item", "key"), "id", ["raw"]).collect())
    assert got == [(4, "raw", 1, "A"), (4, "raw", 1, "A"), (4, "raw", 2, "B"), (4, "raw", 2, "B")]


def test_empty_table(spark):
    assert split_packed(spark.createDataFrame([], "id bigint, a string"), "id", ["a"]).count() == 0


def test_brackets_hide_delimiters():
    assert parse("A [x; y]; B", ((";",), "")) == ["A [x; y]", "B"]
    assert parse('"A ""q"" B"; C', ((";",), '"')) == ['A "q" B', "C"]


def test_very_long_field(spark):
    assert len(items(spark, "; ".join(f"Shelf {i} of many" for i in range(3000)))) == 3000


def test_the_bound_of_the_dictionary_changes_no_result(spark, monkeypatch):
    law = "Harbour Life and Sea Stories"
    rows = [(i, f"Sea Stories; Harbour Life; Shelf {i} of many") for i in range(100)] + [(900 + i, f"{law}; Sea Stories") for i in range(20)] + [(950, law), (951, f"Sea Stories | {law}")]
    df = spark.createDataFrame(rows, "id bigint, shelves string")
    want = sorted(tuple(r) for r in split_packed(df, "id", ["shelves"]).collect())
    assert (950, "shelves", 1, law) in want and (951, "shelves", 2, law) in want
    monkeypatch.setattr(packed, "DICTIONARY_BITS", 3)
    assert sorted(tuple(r) for r in split_packed(df, "id", ["shelves"]).collect()) == want
