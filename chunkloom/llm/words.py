"""Vectorised words of a batch of texts.

A word is, in the lower-cased text, a maximal run of letters or digits (no
underscore); each character U+4E00..U+9FFF is a word of its own.  A batch of
texts becomes flat numpy arrays, so no Python code runs per word: words are
64-bit hashes, and ``offsets[i]:offsets[i + 1]`` are the words of text i.
Null texts have no words.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xC2B2AE3D27D4EB4F)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): spreads every bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _kinds() -> np.ndarray:
    """By code point: 0 no word character, 1 letter or digit, 2 a word of its own."""
    kind = np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    kind[0x4E00:0xA000] = 2
    return kind


@lru_cache(1)
def _spread() -> np.ndarray:
    """A random 64-bit value of every code point."""
    return mix((np.arange(sys.maxunicode + 1, dtype=np.uint64) + np.uint64(1)) * _MUL)


def code_points(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, one separator (0) after each, and where each text starts."""
    kept = [t or "" for t in texts]
    flat = np.frombuffer("\0".join([*kept, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in kept), np.int64, len(kept)), out=starts[1:])
    return flat, starts


class Words:
    """Hashes of the words of a batch; start and end of each word in the lower-cased code points."""

    def __init__(self, texts: Iterable[str | None]):
        self.points, self.starts = code_points(None if t is None else t.lower() for t in texts)
        n = len(self.points)
        kind = _kinds()[self.points]
        first = np.empty(n, bool)
        first[:1] = kind[:1] > 0
        first[1:] = (kind[1:] == 2) | ((kind[1:] == 1) & (kind[:-1] != 1))
        at = np.flatnonzero(first)
        self.at = at
        self.offsets = np.searchsorted(at, self.starts)
        if not len(at):
            self.hashes, self.end = np.zeros(0, np.uint64), at
            return
        inside = np.flatnonzero(kind > 0)
        ordinal = np.cumsum(first[inside]) - 1
        place = (inside - at[ordinal]).astype(np.uint64)
        value = _spread()[self.points[inside]]
        value = (value ^ (place * _MUL2)) * (place * np.uint64(2) + _M1)
        begins = np.flatnonzero(first[inside])
        self.hashes = mix(np.add.reduceat(value ^ (value >> np.uint64(29)), begins))
        self.end = inside[np.append(begins[1:], len(inside)) - 1] + 1

    def __len__(self) -> int:
        return len(self.starts) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n words in a row, and the offsets of each text in them."""
        counts = np.maximum(self.counts() - n + 1, 0)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        total = int(offsets[-1])
        if not total:
            return np.zeros(0, np.uint64), offsets
        owner = np.repeat(np.arange(len(counts)), counts)
        where = np.arange(total) - offsets[owner] + self.offsets[owner]
        out = np.zeros(total, np.uint64)
        for k in range(n):
            out = out * _MUL + self.hashes[where + k]
        return mix(out), offsets


def distinct_by_text(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in ascending order, and their offsets."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[keep], minlength=len(offsets) - 1)
    return values[keep], np.concatenate([[0], np.cumsum(counts)])


def pieces_of(batches: Iterator, chars: int, column: str) -> Iterator:
    """Pandas batches cut so that none holds much more than ``chars`` characters of a column."""
    for frame in batches:
        sizes = frame[column].str.len().fillna(0).to_numpy().cumsum()
        cut = np.searchsorted(sizes, np.arange(chars, sizes[-1] + 1 if len(sizes) else 0, chars))
        last = 0
        for c in np.unique(np.append(cut + 1, len(frame))):
            if c > last:
                yield frame.iloc[last:c]
                last = int(c)
