"""Vectorised word and window hashing over Arrow string columns.

Words are the maximal runs of bytes other than space, tab, LF, VT, FF and CR, so a
word never crosses a text. Everything works on the raw UTF-8 buffer with NumPy: no
Python object per word. Memory is bounded by the slice size, plus eight bytes a word
of one chunk of rows (a chunk is a few MB of text, or a single longer text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
CHUNK_BYTES = 4 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_WINDOW_MULT = 0xD1342543DE82EF95

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, element by element (modulo 2**64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(seed: int, fold: bool) -> np.ndarray:
    """A random 64-bit value for each byte; fold gives A-Z the values of a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT) + np.uint64(seed))
    if fold:
        table[65:91] = table[97:123]
    return table


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = Powers(_MULT), Powers(_WINDOW_MULT)


@dataclass
class Words:
    """Words of consecutive texts: byte spans, 64-bit hashes, and the words' offsets by text."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offset: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offset)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offset) - 1), self.counts)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a copy; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES, rows: int = 65_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes and so many rows; a longer text comes alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, limit: int = SLICE_BYTES, gaps: np.ndarray = SPACE) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]; spans are positions in data. gaps marks the bytes between words."""
    first, last = int(offsets[0]), int(offsets[-1])
    starts, ends, hashes = [], [], []
    pos = first
    while pos < last:
        stop = min(pos + limit, last)
        if stop < last:
            k = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            if k <= pos:  # inside one text: cut at its last white space, or after a word longer than a slice
                gap = np.flatnonzero(gaps[data[pos:stop]])
                k = pos + int(gap[-1]) + 1 if len(gap) else 0
                while not k:
                    text_end = int(offsets[np.searchsorted(offsets, pos, "right")])
                    more = min(stop + limit, text_end)
                    gap = np.flatnonzero(gaps[data[stop:more]])
                    k = stop + int(gap[0]) if len(gap) else (text_end if more == text_end else 0)
                    stop = more
            stop = k
        part = data[pos:stop]
        inside = ~gaps[part]
        begin, final = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        final[:-1] &= ~inside[1:]
        cuts = offsets[np.searchsorted(offsets, pos) : np.searchsorted(offsets, stop, "right")] - pos
        at = cuts[cuts < len(part)]
        begin[at] = inside[at]
        at = cuts[cuts > 0] - 1
        final[at] = inside[at]
        s, e = np.flatnonzero(begin), np.flatnonzero(final) + 1
        if len(s):
            up, down = _BYTE_POWERS.get(len(part))
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[part] * up, out=total[1:])
            h = (total[e] - total[s]) * down[s]
            hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)))
            starts.append(s + pos)
            ends.append(e + pos)
        pos = stop
    empty = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else empty
    end = np.concatenate(ends) if ends else empty
    hashed = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return Words(start, end, hashed, np.searchsorted(start, offsets).astype(np.int64))


def windows(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size consecutive entries, over the whole array, ends of texts not heeded."""
    if len(hashed) < size:
        return np.zeros(0, np.uint64)
    up, down = _WORD_POWERS.get(len(hashed))
    total = np.zeros(len(hashed) + 1, np.uint64)
    np.cumsum(hashed * up, out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: len(hashed) - size + 1] + np.uint64(size))


def window_starts(offset: np.ndarray, size: int) -> np.ndarray:
    """Mask over windows(): True where the window lies in one text."""
    n = int(offset[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for k in range(1, size):
        at = offset[1:-1] - k
        ok[at[(at >= 0) & (at < n)]] = False
    return ok
