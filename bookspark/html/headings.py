"""What a heading is: its keyword and number, its level, whether it divides the book at all. Pure functions of the text."""

from __future__ import annotations

import re
from functools import lru_cache

# Words that divide books from the widest to the narrowest, their other spellings, numerals in words, other vocabularies.
BROAD = {"volume": 1, "vol": 1, "part": 2, "epilogue": 2, "book": 3, "act": 3, "induction": 3}
NARROW = ["chapter", "chap", "section", "scene", "canto", "letter", "lecture", "stave", "fable", "tale", "story", "essay", "sonnet", "hymn", "psalm", "verse", "appendix", "adventure", "epistle"]
ALIASES = {"actus": "act", "scena": "scene", "scoena": "scene", "scaena": "scene", "vol": "volume", "chap": "chapter", "liber": "book"}
NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth last primus prima secundus secunda tertius tertia quartus quarta quintus quinta sextus septimus octavus nonus decimus".split()
FRONT = ["preface", "foreword", "introduction", "introductory", "prologue", "prelude", "dedication", "advertisement", "argument", "to the reader", "note", "author's note", "prefatory note", "epilogue", "conclusion", "afterword", "appendix", "glossary", "dramatis personae", "persons represented", "epigraph", "proem", "postscript"]
NOT_STRUCTURE = re.compile(
    r"^(?:(?:table of )?contents\.?|index|list of (?:illustrations|plates|maps|tables)|illustrations?|plates?|page \w+|by\b.*|(?:translated|edited|illustrated|written|compiled) by\b.*|the end\.?|finis\.?|end of .*|footnotes?:?|notes?:?|endnotes?:?|transcriber.?s? notes?:?.*|continued\.?|copyright.*|(?:london|new york|boston|edinburgh|paris|philadelphia)\b.*|\W*|\d{4}\.?|(?:printed|published) (?:by|in)\b.*|colophon|errata|advertisements?|.*\b(?:publishers?|printers?|& co\.?|and company|press|limited|ltd\.?)\W*)$",
    re.I,
)
# Headings that stand for themselves, of plays, of front matter that may be a stub, of an editor's gaps.
STANDING = re.compile(r"\bEPILOGUE\b|\bPROLOGUE\b|\bAPPENDIX\b|\bINDUCTION\b", re.I)
DRAMATIC = re.compile(r"\b(?:act|scene|prologue|epilogue|tragedy|comedy)\b", re.I)
OPENING = re.compile(r"^(?:preface|prefatory\b|introduction|introductory note|prelude|prologue\b|note\b|note to\b|letter\b|a letter from\b|the publisher to the reader\b|before the curtain\b|etymology\b|extracts\b|some commendatory verses\b)", re.I)
PLACEHOLDER = re.compile(r"(?:\[\s*(?:not\b|omitted\b|wanting\b)|\bnot in early editions\b)", re.I)
ROMAN = r"[ivxlcdm]+"
_NUMBER = rf"(?:{ROMAN}|\d+|(?:{'|'.join(NUMBERS)})(?:[- ](?:{'|'.join(NUMBERS)}))*|(?:the )?(?:{'|'.join(ORDINALS)})(?: and last)?)"
_WORDS = "|".join([*BROAD, *NARROW, *ALIASES])
_LEAD = re.compile(rf"^(?:the )?({_WORDS})s?\.?(?:\s*(?:the\s+)?({_NUMBER})\b|\s*$|\s*[.:—-])", re.I)
_TRAIL = re.compile(rf"^(?:the )?(?:{'|'.join(ORDINALS)}) ({_WORDS})\b", re.I)
_BARE = re.compile(rf"^(?:(?:the )?(?:{_WORDS})s?\.?\s*)?{_NUMBER}\s*[.:—-]*\s*$", re.I)


@lru_cache(4096)
def clean(text: str) -> str:
    """Without note marks and with a space between keyword and numeral."""
    x = re.sub(r"\s*\[\d+\]", "", text).strip()
    x = re.sub(rf"^({_WORDS})([IVXLCDM]+|\d+)\b", r"\1 \2", x, flags=re.I)
    return " ".join(x.split())


@lru_cache(4096)
def keyword(text: str) -> str:
    """The dividing word of a heading, '' if none."""
    m = _LEAD.match(text.strip()) or _TRAIL.match(text.strip())
    w = m[1].lower() if m else ""
    return ALIASES.get(w, w)


def key(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", text.lower())


def bare(text: str) -> bool:
    """Only a keyword and its number, or a number."""
    return bool(_BARE.match(text.strip()))


def front_matter(text: str) -> bool:
    x = " ".join(re.sub(r"[^a-z' ]+", " ", text.lower().replace("’", "'")).split())
    return x in FRONT or any(x.startswith(f"{w} ") and len(x.split()) <= 5 for w in FRONT)


def structural(text: str) -> bool:
    return bool(re.search(r"[^\W_]", text)) and not NOT_STRUCTURE.match(text.strip())


def level(text: str, emphasized: bool = False) -> int:
    """1 for broad divisions and emphasised entries, 3 for sections and scenes, else 2."""
    if emphasized:
        return 1
    w = keyword(text)
    if w in BROAD:
        return 2 if front_matter(text) else 1
    return 3 if w in ("section", "scene") else 2


def matches(entry: str, heading: str) -> bool:
    """Whether an entry of the table of contents names this heading."""
    a, b = key(entry), key(heading)
    if not a or not b:
        return False
    return a == b or (min(len(a), len(b)) >= 6 and (a in b or b in a)) or (min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)) and keyword(entry) == keyword(heading) != "")


def standing(text: str) -> bool:
    return bool(STANDING.search(text))


def dramatic(text: str) -> bool:
    return bool(DRAMATIC.search(text))


def opening(text: str) -> bool:
    return bool(OPENING.match(text))


def placeholder(text: str) -> bool:
    return bool(PLACEHOLDER.search(text))


def plain_number(text: str) -> bool:
    return bool(re.fullmatch(rf"(?:{ROMAN}|\d+)\.?", text.strip(), re.I))


def enumerated(text: str) -> bool:
    """Begins with a number of its own, as "IV. The Mill"."""
    return bool(re.match(rf"(?:{ROMAN}|\d+)[.)]?\s+\S", text.strip(), re.I))


def capitals(text: str, most: int) -> bool:
    """One to `most` words in capitals, without a keyword."""
    words = [w for w in text.split() if re.search(r"[^\W\d_]", w)]
    return 1 <= len(words) <= most and text == text.upper() and not keyword(text)


def speakers(text: str) -> bool:
    """Several names in capitals with hyphens between, as over a dialogue."""
    parts = [p.strip(" .,:;!?()[]") for p in text.split(" - ")]
    return len(parts) > 1 and not keyword(text) and not standing(text) and all(capitals(p, 5) for p in parts)


def title_like(text: str) -> bool:
    """A title of a work or chapter in words of its own."""
    return structural(text) and not keyword(text) and not standing(text) and not speakers(text)


def ignorable(text: str, rank: int) -> bool:
    """A column label "CHAP.", a synopsis, a numbered line among small headings, or several numbered items in one."""
    t = text.strip()
    label = re.fullmatch(r"(?:chap(?:ters?)?)\.?", t, re.I) or re.match(r"synopsis of\b", t, re.I)
    small = rank >= 4 and re.match(rf"(?:{ROMAN}|\d+)\.\s+\S", t, re.I)
    return bool(label or small) or len(re.findall(rf"(?:^|\s)(?:{ROMAN}|\d+)\.\s+\S", t, re.I)) >= 2


def subtitle(text: str) -> str:
    """A heading as the continuation of a bare one, '' if it can't be: no division, speakers or apparatus of its own."""
    t = " ".join(re.sub(r"\s+synopsis of\b.*$", "", text, flags=re.I).strip(" .,:;[]()-").split())
    return "" if not structural(t) or keyword(t) or standing(t) or speakers(t) or re.match(r"(?:a\s+)?notes?\b", t, re.I) else t
