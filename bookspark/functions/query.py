"""The query language of full-text search: a parser to a small tree."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass


class QuerySyntaxError(ValueError):
    """A malformed query."""


@dataclass(frozen=True)
class Phrase:
    """Words in a row; the last may be a prefix; `initial`: at the start of the text."""

    words: tuple[str, ...]
    prefix: bool = False
    initial: bool = False


@dataclass(frozen=True)
class Near:
    """All phrases with at most `gap` words between the first and the last."""

    phrases: tuple[Phrase, ...]
    gap: int = 10


@dataclass(frozen=True)
class Op:
    """AND, OR or NOT of two parts."""

    name: str
    left: object
    right: object


_TOKEN = re.compile(r'\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<open>\()|(?P<close>\))|(?P<star>\*)|(?P<plus>\+)|(?P<caret>\^)|(?P<comma>,)|(?P<colon>:)|(?P<word>[\w\x80-\U0010ffff\x1a]+))')


def words_of(text: str) -> tuple[str, ...]:
    """The words of a text as they are indexed (before stemming)."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return tuple(w for w in re.split(r"[^\w]+|_", flat) if w)


def auto_query(text: str) -> str:
    """Every word between spaces as a phrase of its own, so that no sign has a meaning."""
    return " ".join('"' + w.replace('"', '""') + '"' for w in text.split())


def phrase_query(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


class _Parser:
    """NOT binds tighter than AND, AND tighter than OR; words side by side are the tightest AND."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                rest = text[at:].lstrip()
                if rest.startswith('"'):
                    raise QuerySyntaxError("unterminated string")
                raise QuerySyntaxError(f'syntax error near "{rest[:1]}"')
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def fail(self):
        kind, text = self.peek()
        raise QuerySyntaxError(f'syntax error near "{text}"')

    def parse(self):
        if not self.tokens:
            raise QuerySyntaxError('syntax error near ""')
        tree = self.either()
        if self.peek()[0] != "end":
            self.fail()
        return tree

    def _binary(self, word: str, part):
        left = part()
        while self.peek() == ("word", word):
            self.take()
            left = Op(word, left, part())
        return left

    def either(self):
        return self._binary("OR", self.both)

    def both(self):
        return self._binary("AND", self.without)

    def without(self):
        return self._binary("NOT", self.row)

    def row(self):
        left = self.primary()
        grouped = self.tokens[self.at - 1][0] == "close" and not isinstance(left, Near)
        while self.peek()[0] in ("string", "word", "caret") and self.peek()[1] not in ("AND", "OR", "NOT"):
            if grouped:
                self.fail()  # words can't follow a group without an operator
            left = Op("AND", left, self.primary())
        return left

    def primary(self):
        kind, text = self.peek()
        if kind == "open":
            self.take()
            tree = self.either()
            if self.take()[0] != "close":
                self.at -= 1
                self.fail()
            return tree
        if (kind, text) == ("word", "NEAR") and self.peek(1)[0] == "open":
            self.take(), self.take()
            phrases = [self.phrase()]
            while self.peek()[0] in ("string", "word", "caret"):
                phrases.append(self.phrase())
            gap = 10
            if self.peek()[0] == "comma":
                self.take()
                kind, text = self.take()
                if kind != "word" or not text.isdigit():
                    raise QuerySyntaxError(f'expected integer, got "{text}"')
                gap = int(text)
            if self.take()[0] != "close":
                self.at -= 1
                self.fail()
            return phrases[0] if len(phrases) == 1 else Near(tuple(phrases), gap)
        if kind == "word" and text not in ("AND", "OR", "NOT") and self.peek(1)[0] == "colon":
            if text.lower() != "content":
                raise QuerySyntaxError(f"no such column: {text}")
            self.take(), self.take()
            return self.primary()
        return self.phrase()

    def phrase(self) -> Phrase:
        initial = self.peek()[0] == "caret"
        if initial:
            self.take()
        words: list[str] = []
        while True:
            kind, text = self.peek()
            if kind not in ("string", "word") or text in ("AND", "OR", "NOT"):
                self.fail()
            self.take()
            words += words_of(text[1:-1].replace('""', '"') if kind == "string" else text)
            if self.peek()[0] != "plus":
                break
            self.take()
        prefix = self.peek()[0] == "star"
        if prefix:
            self.take()
        return Phrase(tuple(words), prefix, initial)


def parse_query(text: str):
    """The tree of a query; raises QuerySyntaxError."""
    return _Parser(text).parse()


def phrases(tree) -> list[Phrase]:
    """All phrases of the tree, in order."""
    if isinstance(tree, Phrase):
        return [tree]
    if isinstance(tree, Near):
        return list(tree.phrases)
    return phrases(tree.left) + phrases(tree.right)
