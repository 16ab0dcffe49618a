"""FM-index of a sequence of numbers and of its reverse, extended in both directions.

Suffixes are sorted by their first ``DEPTH`` numbers, which is enough to count and extend
patterns of up to ``DEPTH`` numbers. 0 parts the pieces of the text and is in no pattern.
Intervals of many patterns are extended at once, as numpy arrays, in steps of about ``STEP``
occurrences, so that what a step works with stays small beside the index.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

DEPTH = 5
STEP = 1 << 17


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    out[: max(len(x) - by, 0)] = x[by:]
    return out


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    new = np.zeros(len(key), np.int64)
    sorted_key = key[order]
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new)
    return out


def transform(text: np.ndarray) -> np.ndarray:
    """Number before each suffix, in the order of the suffixes' first ``DEPTH`` numbers."""
    text = text.astype(np.int64)
    rank, width = text, 1
    while 2 * width <= DEPTH:
        rank = _ranks(rank * (len(text) + int(text.max()) + 1) + _shifted(rank, width))
        width *= 2
    for k in range(width, DEPTH):
        rank = _ranks(rank * (int(text.max()) + 1) + _shifted(text, k))
    order = np.argsort(rank, kind="stable")
    return text[order - 1].astype(np.int32)


@dataclass
class Patterns:
    """``words[k]`` of each pattern, its first place in both orders, its number of occurrences."""

    words: list[np.ndarray]
    ahead: np.ndarray
    back: np.ndarray
    size: np.ndarray

    def only(self, some: np.ndarray) -> Patterns:
        return Patterns([w[some] for w in self.words], self.ahead[some], self.back[some], self.size[some])


class TwoWayIndex:
    """Made of the transforms of the text (``before``) and of its reverse (``after``)."""

    def __init__(self, before: np.ndarray, after: np.ndarray, numbers: int):
        self.before, self.after, self.numbers = before, after, numbers
        self.many = np.bincount(after, minlength=numbers)
        self.first = np.cumsum(self.many) - self.many

    @classmethod
    def of(cls, text: np.ndarray, numbers: int) -> TwoWayIndex:
        """``text`` begins and ends with 0."""
        return cls(transform(text), transform(text[::-1]), numbers)

    def single(self) -> Patterns:
        """All numbers of the text but 0."""
        words = np.flatnonzero(self.many)
        words = words[words > 0]
        first = self.first[words].astype(np.int32)
        return Patterns([words.astype(np.int32)], first, first, self.many[words].astype(np.int32))

    def _extended(self, places: np.ndarray, symbols: np.ndarray, left: np.ndarray, size: np.ndarray):
        """``(pattern, number, smaller ones in the interval, first place after it, occurrences)``."""
        before = np.cumsum(size, dtype=np.int64) - size
        edge = np.unique(np.r_[np.searchsorted(before, np.arange(0, int(size.sum(dtype=np.int64)) + 1, STEP)), 0, len(size)])
        steps = [slice(i, j) for i, j in zip(edge[:-1], edge[1:], strict=True)] or [slice(0, 0)]
        found = [self._step(places, symbols, left[s].astype(np.int64), size[s].astype(np.int64), s.start) for s in steps]
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def _step(self, places: np.ndarray, symbols: np.ndarray, left: np.ndarray, size: np.ndarray, number_of_first: int):
        owner = np.repeat(np.arange(len(left)), size)
        at = np.arange(len(owner)) + np.repeat(left - (np.cumsum(size) - size), size)
        key = owner * self.numbers + symbols[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        many = np.diff(np.r_[start, len(key)])
        which, number = np.divmod(key[start], self.numbers)
        smaller = start - (np.cumsum(size) - size)[which]
        words = number > 0
        out = (which + number_of_first, number, smaller, places[at[order[start]]], many)
        return [x[words].astype(np.int32) for x in out]

    def _places(self, symbols: np.ndarray) -> np.ndarray:
        """Place, in the order, of the suffix that starts one number earlier."""
        small = symbols.astype(np.uint16) if self.numbers <= 1 << 16 else symbols
        out = np.empty(len(symbols), np.int32)
        out[np.argsort(small, kind="stable")] = np.arange(len(symbols))
        return out

    @cached_property
    def _places_ahead(self) -> np.ndarray:
        return self._places(self.before)

    @cached_property
    def _places_back(self) -> np.ndarray:
        return self._places(self.after)

    def extend_right(self, p: Patterns) -> Patterns:
        """Every pattern with every number that follows it."""
        which, number, smaller, back, many = self._extended(self._places_back, self.after, p.back, p.size)
        return Patterns([*[w[which] for w in p.words], number], p.ahead[which] + smaller, back, many)

    def extend_left(self, p: Patterns) -> Patterns:
        """Every pattern with every number that stands before it."""
        which, number, smaller, ahead, many = self._extended(self._places_ahead, self.before, p.ahead, p.size)
        return Patterns([number, *[w[which] for w in p.words]], ahead, p.back[which] + smaller, many)
