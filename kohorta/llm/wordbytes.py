"""Words and their hashes for blocks of UTF-8 texts, as numpy arrays.

Helper of the operators that read whole texts inside Arrow batches. A block joins
the bytes of several whole texts; all functions work on the block at once.
A word is a run of bytes other than 0x20 and 0x09-0x0D, so it never depends on
the position of a text inside a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_LANES = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BYTE_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, bytes, offsets)`` for runs of whole texts of about ``limit`` bytes.

    Null texts are empty. A longer text is a block of its own.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Block:
    """Texts of one block with the places of their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        word = ~IS_SPACE[data]
        self.word_byte = word
        begin = np.zeros(len(data) + 1, bool)
        begin[offsets] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | begin[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | begin[1:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets[1:], self.starts, "right")
        self._sums = None

    def prefix_sums(self, data: np.ndarray | None = None) -> np.ndarray:
        data = self.data if data is None else data
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * _power(_BASE, len(data), "up"), dtype=np.uint64, out=sums[1:])
        return sums

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span, equal for equal bytes."""
        down = _power(_INVERSE, len(sums), "down")
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        sums = self.prefix_sums(LOWER[self.data] if lower else None)
        return self.span_hashes(self.starts, self.ends, sums)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def count(self, doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, minlength=self.n).astype(np.int64)


def shingles(words: np.ndarray, doc: np.ndarray, size: int, short: bool = False):
    """``(text of each shingle, first word, hash)`` of all runs of ``size`` words.

    With ``short``, a text of fewer words gives its whole sequence as one shingle.
    """
    n = len(words)
    whole = np.flatnonzero(doc[size - 1 :] == doc[: n - size + 1]) if n >= size else np.zeros(0, np.int64)
    value = np.full(len(whole), size, np.uint64) * _ODD
    for k in range(size):
        value += words[whole + k] * _LANES[k]
    at, value = whole, mix(value)
    if short and n:
        begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        length = np.diff(np.r_[begin, n])
        few = length < size
        begin, length = begin[few], length[few]
        extra = length.astype(np.uint64) * _ODD
        for k in range(size - 1):
            inside = length > k
            extra[inside] += words[begin[inside] + k] * _LANES[k]
        at, value = np.r_[at, begin], np.r_[value, mix(extra)]
    return doc[at], at, value
