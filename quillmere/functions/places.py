"""Tokens of whole batches of texts as places in a list of terms, with NumPy on the characters: no string is made for a token.

The tokens are those of `text.tokens`: composed, lower case, runs of letters, digits and `_`; words are runs without white space, as `chunking` cuts them.
Letters are those of Python's Unicode: an older Java lacks the latest, so terms to be found come from `words`."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Characters that are looked at together (or one longer text).
CHARS = 1_000_000
_OTHER, _TOKEN, _SPACE = range(3)


@cache
def _kinds() -> np.ndarray:
    """The kind of each character: part of a token, white space, or other."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    every = "".join(" " if 0xD800 <= c < 0xE000 else chr(c) for c in range(sys.maxunicode + 1))
    for m in re.finditer(r"\w+", every):
        kinds[m.start() : m.end()] = _TOKEN
    kinds[[ord(c) for c in " \t\n\x0b\f\r"]] = _SPACE
    return kinds


def _form(text: str | None) -> str:
    text = text or ""
    return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()


@F.arrow_udf(ArrayType(StringType()))
def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The tokens of a few texts, such as questions, as strings; none of null."""
    for x in batches:
        yield pa.array([re.findall(r"\w+", _form(t)) for t in x.to_pylist()], pa.list_(pa.string()))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of size[0] numbers, then those of the next."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Found:
    """The tokens of some texts: the place of each (-1 if not among the terms), its text and its word in it; the number of words and tokens of each text,
    and the number of tokens of each word."""

    def __init__(self, place: np.ndarray, text: np.ndarray, word: np.ndarray, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> None:
        self.place, self.text, self.word, self.words, self.tokens, self.sizes = place, text, word, words, tokens, sizes


class Places:
    """Finds terms by a polynomial hash of their characters modulo 2**64, then compares the characters: a hit is the term, not its hash."""

    def __init__(self, terms: list[str]) -> None:
        self.size = np.array([len(t) for t in terms], np.int64)
        self.points = _points("".join(terms))
        self.start = np.cumsum(self.size) - self.size
        for self.base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93):
            hashes = self._hashes(self.points, self.start, self.start + self.size)
            self.order = np.argsort(hashes)
            self.hashes = hashes[self.order]
            if len(np.unique(hashes)) == len(terms):
                return
        raise ValueError("terms that repeat, or hashes that meet under every base")

    def _hashes(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each span the sum of its characters times the powers of base from its start on: prefix sums, times the inverse power of the start."""
        powers, inverse = (_powers(b, max(CHARS, len(points)) + 1) for b in (self.base, pow(self.base, -1, 2**64)))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(points * powers[: len(points)], out=sums[1:])
        return (sums[end] - sums[start]) * inverse[start]

    def _places(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        place = np.full(len(start), -1, np.int64)
        if not len(self.hashes) or not len(start):
            return place
        h = self._hashes(points, start, end)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        size = end - start
        hit = np.flatnonzero((self.hashes[at] == h) & (self.size[self.order[at]] == size))
        found = self.order[at[hit]]
        size = size[hit]
        same = points[spans(start[hit], size)] == self.points[spans(self.start[found], size)]
        whole = np.add.reduceat(same, np.cumsum(size) - size, dtype=np.int64) == size if len(hit) else np.zeros(0, bool)
        place[hit[whole]] = found[whole]
        return place

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, Found]]:
        """(first, end, found) of runs of texts, CHARS or one text at a time."""
        first, run, n = 0, [], 0
        for i, t in enumerate(texts):
            t = _form(t)
            if run and n + len(t) >= CHARS:
                yield first, i, self._find(run)
                first, run, n = i, [], 0
            run.append(t)
            n += len(t) + 1
        if run:
            yield first, len(texts), self._find(run)

    def _find(self, texts: list[str]) -> Found:
        points = _points("\n".join(texts))
        kinds = np.full(len(points) + 2, _SPACE, np.uint8)
        np.take(_kinds(), points, out=kinds[1:-1])
        inside = kinds == _TOKEN
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        words = np.flatnonzero((kinds[1:-1] != _SPACE) & (kinds[:-2] == _SPACE))
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        of_words, of_tokens = np.searchsorted(words, begin), np.searchsorted(start, begin)
        word = np.searchsorted(words, start, side="right") - 1
        text = np.repeat(np.arange(len(texts)), np.diff(of_tokens))
        return Found(self._places(points, start, end), text, word - of_words[text], np.diff(of_words), np.diff(of_tokens), np.bincount(word, minlength=len(words)))
