"""Exact byte-pair encoding by dynamic programming over prefixes.

The encoding of a text ends, at every prefix, in one certain token. A token t that is a suffix of the prefix is this
one if and only if the last token of the prefix without t and t may stand side by side: undoing the merges from the
seam outwards, no pair across the seam may have a merge that the encoder would have made before one of those undone.
So one scan finds, for each prefix, all vocabulary entries that end there (an automaton over the whole vocabulary),
tests them from the longest, and keeps the only one that fits; back-pointers from the end give the ids.

The scan runs over pieces of the public pre-tokenizing pattern. Results of pieces are kept in a table of bounded size
for each worker, as words repeat; a text's long unbroken pieces are scanned once and not kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.operators.layout import spread

TOKENIZERS = "/opt/tokenizers"
#: The pre-tokenizing pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept per worker, and the longest of them.
KEPT, LONGEST = 400_000, 64


def _bytes_of_signs() -> dict[str, int]:
    """The printable stand-ins that the vocabulary file has for bytes: printable Latin-1 signs for themselves, the others in order from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """The tokenizer of one vocabulary file (json with `vocab` and `merges`), without special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        sign, vocab = _bytes_of_signs(), model["vocab"]
        raw = lambda t: bytes(sign[c] for c in t).decode("latin-1")
        byte = {vocab[s]: b for s, b in sign.items()}
        self.merged: dict[tuple[int, int], int] = {}  # a pair -> when it is merged
        self.parts: dict[int, tuple[int, int, int]] = {}  # a token -> its two parts, and when they are merged
        self.length: dict[int, int] = {i: 1 for i in byte}
        self.auto = ahocorasick.Automaton()
        for i in byte:
            self.auto.add_word(chr(byte[i]), (i, 1))
        for when, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            i, pair = vocab[a + b], (vocab[a], vocab[b])
            self.merged[pair] = when
            self.parts.setdefault(i, (*pair, when))
            self.length[i] = self.length[pair[0]] + self.length[pair[1]]
            self.auto.add_word(raw(a + b), (i, self.length[i]))
        self.auto.make_automaton()
        self.find = regex.compile(PATTERN).findall
        self.units = regex.compile(r"(?<=\S) (?=\S)").split
        self.odd = regex.compile(r"  |(?<=\s) | (?=\s)").search
        self.fits: dict[int, bool] = {}
        self.kept: dict[str, tuple[int, ...]] = {}

    def fit(self, left: int, right: int) -> bool:
        """Whether the encoder would leave these two tokens side by side."""
        merged, parts = self.merged, self.parts
        before = 1 << 60
        while True:
            at = merged.get((left, right))
            if at is not None and at < before:
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            # undo the later merge; of two equal ones the left was made first, so a pair that is merged at that moment would have come before the right one
            if b is None or (a is not None and a[2] > b[2]):
                before, left = a[2], a[1]
            else:
                before, right = b[2] + 1, b[0]

    def scan(self, piece: bytes) -> tuple[int, ...]:
        """The ids of the piece: the last token of every prefix, then back from the end."""
        last, known, length = [-1] * (len(piece) + 1), self.fits, self.length
        for end, (i, n) in self.auto.iter(piece.decode("latin-1")):  # of those that end at one place, the longest first
            if last[end + 1] < 0:
                if end + 1 == n:
                    last[n] = i
                elif (left := last[end + 1 - n]) >= 0:
                    yes = known.get(pair := left << 20 | i)
                    if yes is None:
                        if len(known) >= KEPT:
                            known.clear()
                        yes = known[pair] = self.fit(left, i)
                    if yes:
                        last[end + 1] = i
        out, e = [], len(piece)
        while e:
            out.append(last[e])
            e -= length[last[e]]
        return tuple(reversed(out))

    def piece(self, piece: str) -> tuple[int, ...]:
        had = self.kept.get(piece)
        if had is None:
            had = self.scan(piece.encode("utf-8", "replace"))
            if len(piece) <= LONGEST:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[piece] = had
        return had

    def unit(self, unit: str) -> tuple[int, ...]:
        """`unit` begins and ends where the pattern must cut."""
        pieces = self.find(unit)
        if len(pieces) == 1:
            return self.piece(unit)
        out = tuple(i for p in pieces for i in self.piece(p))
        if len(unit) <= LONGEST:
            self.kept[unit] = out
        return out

    def ids(self, text: str | None) -> list[int]:
        """The ids of the text; none for a null or empty one."""
        if not text:
            return []
        # the pattern always cuts before a space that stands alone between two other signs
        units = self.units(text) if self.odd(text) else text.split(" ")
        kept, unit = self.kept, self.unit
        out = list(kept.get(units[0]) or unit(units[0])) if units[0] else []
        for u in units[1:]:
            out += kept.get(u := " " + u) or unit(u)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _path(tokenizer: str, folder: str) -> str:
    return f"{folder}/{tokenizer}.json"


def encode(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(`key`, ids: array<int>) of every row; null and empty texts get an empty list. Repeated rows come out repeated, extra columns don't matter."""
    path = _path(tokenizer, folder)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path).ids
        for b in batches:
            lists = [ids(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key), F.col(text))).mapInArrow(each, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(`key`, n_tokens: int) of every row; 0 for null and empty texts."""
    path = _path(tokenizer, folder)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = encoder(path).ids
        for b in batches:
            yield pd.DataFrame({key: b[key], "n_tokens": [len(ids(t)) if isinstance(t, str) else 0 for t in b[text]]})

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key), F.col(text))).mapInPandas(each, f"`{key}` {kind}, n_tokens int")
