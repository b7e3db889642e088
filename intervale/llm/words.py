"""Words of many texts at once: offsets, 64-bit hashes and word n-grams, all by numpy on Arrow's own bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its hash is a polynomial over a fixed table of random
64-bit values, finished by an avalanche step; equal bytes have equal hashes in every process.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa

from .common import text_of

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE[_SPACE] = 0
#: A-Z to a-z, other bytes as they are.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_G = np.uint64(0x9E3779B97F4A7C15)
_G_INV = np.uint64(pow(int(_G), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_G, _G_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a slice of texts. start and end are byte offsets in `data`; text[k] is the text of word k;
    first[i]:first[i+1] are the words of text i; base[i] is where text i begins."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray
    base: np.ndarray

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, np.uint64)
        power, inverse = _power_tables(len(self.data) + 1)
        sums = np.add.reduceat(_BYTE[self.data] * power[: len(self.data)], self.start)
        return mix(sums * inverse[self.start] + (self.end - self.start).astype(np.uint64))


def bytes_of(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins (one more for the end)."""
    array = text_of(column)
    ends = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8)[ends[0] : ends[-1]] if array.buffers()[2] is not None and len(ends) else np.empty(0, np.uint8)
    return (_LOWER[data] if lower else data), (ends - ends[0] if len(ends) else np.zeros(1, np.int64))


def words_of(column: pa.Array, lower: bool = False, extra_space: np.ndarray | None = None) -> Words:
    """extra_space: further byte values that end words (a mask of 256)."""
    data, base = bytes_of(column, lower)
    space = (_SPACE if extra_space is None else _SPACE | extra_space)[data]
    if extra_space is not None:
        data = np.where(space, np.uint8(0x20), data)
    inside = ~space
    begins = inside.copy()
    begins[1:] &= space[:-1]
    heads = base[:-1][base[:-1] < base[1:]]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= space[1:]
    tails = base[1:][base[:-1] < base[1:]] - 1
    ends[tails] = inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, base)
    text = np.repeat(np.arange(len(base) - 1), np.diff(first))
    return Words(data, start, end, text, first, base)


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside texts, and the position of the first word of each."""
    count = len(hashes)
    if count < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = hashes[: count - n + 1].copy()
    for k in range(1, n):
        grams = mix(grams * _G + hashes[k : count - n + 1 + k])
    left = np.repeat(first[1:], np.diff(first))[: count - n + 1]
    at = np.flatnonzero(np.arange(count - n + 1) + n <= left)
    return grams[at], at


def ordered_by_text(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The values of each text in order; text must not fall. Sorting text by text in place is many times faster than
    one ordering of all pairs."""
    values = values.copy()
    begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.empty(0, np.int64)
    for a, b in pairwise(np.append(begins, len(text))):
        values[a:b].sort()
    return values


def distinct_by_text(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs, ordered by text, then value."""
    if not len(values):
        return values, text
    if (text[1:] < text[:-1]).any():
        order = np.argsort(text, kind="stable")
        values, text = values[order], text[order]
    values = ordered_by_text(values, text)
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[keep], text[keep]
