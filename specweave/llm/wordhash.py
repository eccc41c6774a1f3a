"""Hashes of the words of many texts at once, without an object per word.

Words are what ``text.lower().split()`` gives for UTF-8 bytes: ASCII letters are lower-cased and ASCII white space
separates. A word's hash is the sum of its bytes' random values times powers of an odd number (mod 2**64), mixed;
the sums of all words come from one running sum over the bytes.

Defined cases: null and empty texts have no word; a text of any length is worked through in bounded pieces; a word
longer than PIECE bytes is hashed by BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes worked on at a time; what is held is some 30 times this.
PIECE = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OWN_VALUE = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE = _OWN_VALUE[_LOWER]
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2 ** 64 for i < n, by doubling."""
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step & (1 << 64) - 1
    return out[:n]


_UP, _DOWN = _powers(_BASE, PIECE), _powers(pow(_BASE, -1, 1 << 64), PIECE)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without a copy where Arrow allows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)), at - at[0]


def borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte behind) of every word; a word does not reach from one text into the next."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[1:] |= space
    starts = np.flatnonzero(cut[:-1] & ~space)
    cut[:-1] = space
    cut[offsets] = True
    return starts, np.flatnonzero(cut[1:] & ~space) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """The hash of each word data[starts:ends], lower-cased or as it is; words are in order and do not overlap."""
    out, value = np.empty(len(starts), np.uint64), _VALUE if lower else _OWN_VALUE
    long = np.flatnonzero(ends - starts > PIECE)
    for i in long:
        word = data[starts[i] : ends[i]]
        out[i] = int.from_bytes(hashlib.blake2b((_LOWER[word] if lower else word).tobytes(), digest_size=8).digest(), "little")
    lo = 0
    stops = [*long.tolist(), len(starts)]
    for stop in stops:
        while lo < stop:
            a = starts[lo]
            hi = min(int(np.searchsorted(ends, a + PIECE, "right")), stop)
            total = np.zeros(ends[hi - 1] - a + 1, np.uint64)
            np.cumsum(value[data[a : ends[hi - 1]]] * _UP[: len(total) - 1], out=total[1:])
            s = starts[lo:hi] - a
            out[lo:hi] = mix((total[ends[lo:hi] - a] - total[s]) * _DOWN[s])
            lo = hi
        lo = stop + 1
    return out


@dataclass
class Words:
    """The words of a run of texts: hash, text (from 0), line over all texts, and the first word of each text."""

    h: np.ndarray
    text: np.ndarray
    first: np.ndarray

    def __getitem__(self, i: int) -> np.ndarray:
        return self.h[self.first[i] : self.first[i + 1]]

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self[i] for i in range(len(self.first) - 1))


def words(column: pa.Array) -> Words:
    """The hashed words of all texts of a column."""
    data, offsets = raw(column)
    starts, ends = borders(data, offsets)
    first = np.searchsorted(starts, offsets)
    return Words(hashes(data, starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, line in it from 0) of each word, lines ending at line feeds."""
    breaks = np.flatnonzero(data == 10)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return text, np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[text]


def parts(column: pa.Array, size: int = 8 * PIECE) -> Iterator[tuple[int, pa.Array]]:
    """(number of the first text, texts) in runs of about ``size`` bytes, or of one longer text."""
    _, offsets = raw(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, column.slice(lo, hi - lo)
        lo = hi
