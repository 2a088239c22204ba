import pytest

from bookspark.html import passes as P
from bookspark.html.chunker import Section, chunk_html
from bookspark.plans.samples import PAGES


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    rows = chunk_html(page)
    assert [" / ".join(filter(None, r[1:5])) for r in rows if r[6] == "heading"] == want
    assert [r[0] for r in rows] == list(range(len(rows))) and all(r[7] == len(r[5]) for r in rows)


def sections(*rows):
    return [Section(10 * i, 10 * i, text, level, rank) for i, (text, level, rank) in enumerate(rows)]


def levels(found):
    return [s.level for s in found]


def test_orphans():
    letters = [(f"LETTER {i}", 2, 3) for i in "I II III IV".split()]
    assert levels(P.without_orphans(sections(*letters, ("CONCLUSION", 1, 2)))) == [2] * 5
    assert levels(P.without_orphans(sections(("BOOK I", 1, 2), *letters))) == [1, 2, 2, 2, 2]
    assert levels(P.without_orphans(sections(("The Mill", 1, 2), *letters))) == [1, 2, 2, 2, 2]  # it holds them
    assert levels(P.without_orphans(sections(*letters[:2], ("CONCLUSION", 1, 2)))) == [2, 2, 1]
    assert P.without_orphans([]) == P.unwrapped([]) == P.without_printed_contents([]) == []


def test_apparatus():
    rows = sections(("CHAPTER I", 2, 2), ("APPENDIX", 2, 2), ("Of the Text", 2, 2))
    assert len(P.before_apparatus(rows)) == 2
    assert len(P.before_apparatus([*rows, *sections(("Another Work", 1, 1))])) == 4
    assert len(P.before_apparatus(sections(*[(f"The {x}", 2, 2) for x in "Mill Bell Toll".split()], ("Conclusion", 2, 2), ("The Sea", 2, 2)))) == 5


def test_parents():
    assert P.parents([1, 2, 3, 2, 1, 3]) == [-1, 0, 1, 0, -1, 4]
