"""Periodic run detection by internal pattern matching.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are equal) that
is at least ``max(LEAST, TIMES * q)`` words long and that no neighbouring word extends.

Each text is worked out whole where it lies, a block of texts at a time:

* prefix doubling sorts the suffixes and keeps, for each power of two, the rank of the
  stretch of that length at every word: equal ranks are equal stretches;
* a run with ``B <= q < 2 B`` (``B`` a power of two) holds a dyadic block, the ``B`` words
  from a multiple of ``B``, and the same words again ``q`` later. So each dyadic block asks
  for its occurrences that start in the neighbouring window of ``B`` words. They are the
  positions of that window in the block's interval of the suffix array, which a wavelet
  tree over the array answers by range successor;
* the occurrences are an arithmetic progression, whose members are candidate periods. The
  candidates are extended to both sides by ranks, from the longest stretches down, and
  stretches found with several periods keep the smallest.

Blocks that occur less than three times in their text hold no run and ask nothing.

Defined results:

* null or empty text: no words, no runs, digests of nothing;
* null ``doc_id``: the words stay as they are; equal ids: each row is a text of its own;
* very long texts are one block; memory is a few dozen bytes a word, and more where long
  passages repeat inside the text (one rank a word for each doubling);
* an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kohorta.llm.frames import arrow_limits
from kohorta.llm.joined import joined_digests
from kohorta.llm.wordbytes import Block, text_blocks

LEAST, TIMES = 6, 4


def repeated_words(doc_ids: list, sizes: np.ndarray) -> np.ndarray:
    """Place of the word that stands at each place of the texts, numbered through.

    Ids whose digest ends in 0 have their words from some place on repeated at a period.
    """
    first = np.cumsum(sizes) - sizes
    take = np.arange(int(sizes.sum()))
    for doc_id, start, n in zip(doc_ids, first.tolist(), sizes.tolist(), strict=True):
        if doc_id is None or not n:
            continue
        h = zlib.crc32(b"%d" % doc_id)
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            take[start + a : start + n] = start + a + np.arange(n - a) % p
    return take


def _dense(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Numbers of words, ascending by text, so that no two texts share one."""
    order = np.lexsort((words, doc))
    new = np.zeros(len(words), np.int64)
    sorted_words, sorted_doc = words[order], doc[order]
    new[1:] = (sorted_words[1:] != sorted_words[:-1]) | (sorted_doc[1:] != sorted_doc[:-1])
    out = np.empty(len(words), np.int64)
    out[order] = np.cumsum(new)
    return out


class Suffixes:
    """Suffix array of texts numbered by ``_dense`` and the ranks of its doublings.

    ``ranks[k][i]`` is the first place, in the array, of the suffixes that share their
    first ``2**k`` words with suffix ``i``; ``sizes[k]`` at that place is their number.
    """

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        n = len(symbols)
        self.array = np.argsort(symbols, kind="stable")
        rank = np.empty(n, np.int64)
        self.ranks, self.sizes = [], []
        slots = np.arange(n)
        key, step = symbols[self.array], 0
        while True:
            members = self.array[slots]
            new = np.ones(len(slots), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)
            many = np.diff(np.r_[first, len(slots)])
            rank[members] = np.repeat(slots[first], many)
            size = np.ones(n, np.int32)
            size[slots[first]] = many
            self.ranks.append(rank.astype(np.int32))
            self.sizes.append(size)
            slots = slots[np.repeat(many > 1, many)]
            if not len(slots):
                return
            step = 1 << (len(self.ranks) - 1)
            members = self.array[slots]
            later = members + step
            inside = later < ends[members]
            key = rank[members] * (n + 1) + np.where(inside, rank[np.minimum(later, n - 1)] + 1, 0)
            order = np.argsort(key, kind="stable")
            self.array[slots], key = members[order], key[order]

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from ``i`` and ``j`` (``i < j``) on."""
        out, n = np.zeros(len(i), np.int64), len(self.array)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i + out, j + out
            there = b < n
            b = np.minimum(b, n - 1)
            out += (there & (self.ranks[k][np.minimum(a, n - 1)] == self.ranks[k][b])).astype(np.int64) << k
        return out

    def extend_back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree before ``i`` and ``j`` (``i < j``)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i - out - (1 << k), j - out - (1 << k)
            there = a >= 0
            out += (there & (self.ranks[k][np.maximum(a, 0)] == self.ranks[k][np.maximum(b, 0)])).astype(np.int64) << k
        return out


class WaveletTree:
    """Numbers stored bit by bit, highest first, zeros before ones on each level."""

    def __init__(self, values: np.ndarray):
        self.bits = max(int(values.max()).bit_length() if len(values) else 0, 1)
        self.levels = []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append(ones)
            values = np.concatenate([values[~one], values[one]])

    def below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers of each range ``left:right`` are less than ``bound``."""
        out = np.where(bound >> self.bits > 0, right - left, 0)
        left, right = left.copy(), right.copy()
        for b, ones in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one_l, one_r = ones[left], ones[right]
            up = (bound >> b & 1).astype(bool)
            out += np.where(up & (bound >> self.bits == 0), (right - one_r) - (left - one_l), 0)
            zeros = len(ones) - 1 - ones[-1]
            left = np.where(up, zeros + one_l, left - one_l)
            right = np.where(up, zeros + one_r, right - one_r)
        return out

    def kth(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number with ``k`` smaller ones in each range."""
        out = np.zeros(len(left), np.int64)
        left, right, k = left.copy(), right.copy(), k.copy()
        for b, ones in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one_l, one_r = ones[left], ones[right]
            low = (right - one_r) - (left - one_l)
            up = k >= low
            k -= np.where(up, low, 0)
            out |= up.astype(np.int64) << b
            zeros = len(ones) - 1 - ones[-1]
            left = np.where(up, zeros + one_l, left - one_l)
            right = np.where(up, zeros + one_r, right - one_r)
        return out


def progressions(suffixes: Suffixes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place, period)`` candidates of the dyadic blocks of all texts."""
    many = suffixes.sizes[0][suffixes.ranks[0][suffixes.array]] >= 3
    place = np.r_[0, np.cumsum(many)]
    tree = WaveletTree(suffixes.array[many])
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in range(len(suffixes.ranks)):
        block = 1 << k
        count = np.maximum(sizes // block, 0) * (sizes >= max(TIMES * block, LEAST))
        if not count.any():
            break
        owner = np.repeat(np.arange(len(sizes)), count)
        at = starts[owner] + block * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
        left = suffixes.ranks[k][at].astype(np.int64)
        size = suffixes.sizes[k][left]
        asks = size >= (LEAST if k == 0 else 3)
        at, owner, left, size = at[asks], owner[asks], left[asks], size[asks]
        if not len(at):
            continue
        right = place[left + size]
        left = place[left]
        stop = np.minimum(at + 2 * block, (starts + sizes)[owner])
        before = tree.below(left, right, at + block)
        within = tree.below(left, right, stop) - before
        hit = within > 0
        at, left, right, before, within = (x[hit] for x in (at, left, right, before, within))
        if not len(at):
            continue
        first = tree.kth(left, right, before)
        step = np.zeros(len(at), np.int64)
        more = within > 1
        step[more] = tree.kth(left[more], right[more], before[more] + 1) - first[more]
        number = np.arange(int(within.sum())) - np.repeat(np.cumsum(within) - within, within)
        found.append((np.repeat(at, within), np.repeat(first - at, within) + number * np.repeat(step, within)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, period)`` of all runs, by start and period; places count through.

    ``words`` are hashes of the words of texts of ``sizes`` words each.
    """
    none = (np.zeros(0, np.int64),) * 3
    if not len(words):
        return none
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    suffixes = Suffixes(_dense(words, doc), (starts + sizes)[doc])
    at, period = progressions(suffixes, starts, sizes)
    if not len(at):
        return none
    start = at - suffixes.extend_back(at, at + period)
    end = at + period + suffixes.extend(at, at + period)
    long = end - start >= np.maximum(LEAST, TIMES * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


FIELDS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _block_rows(block: Block, doc_ids: list, change) -> tuple:
    sizes = block.count(block.doc)
    take = change(doc_ids, sizes) if change else np.arange(len(block.starts))
    start, end, period = find_runs(block.word_hashes()[take], sizes)
    starts = np.cumsum(sizes) - sizes
    owner = np.searchsorted(starts + sizes, start, "right")
    n_runs = block.count(owner)

    marks = np.zeros(len(take) + 1, np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, end, -1)
    kept = np.flatnonzero(np.cumsum(marks)[:-1] == 0)
    collapsed = joined_digests(block, take[kept], block.doc[kept])

    nothing = hashlib.sha256().hexdigest()
    digests, best = [nothing] * block.n, np.full((3, block.n), -1, np.int64)
    edge = np.searchsorted(owner, np.arange(block.n + 1))
    own, length = start - starts[owner], end - start
    for d in np.flatnonzero(n_runs):
        some = slice(edge[d], edge[d + 1])
        rows = list(zip(own[some].tolist(), length[some].tolist(), period[some].tolist(), strict=True))
        digests[d] = hashlib.sha256("".join("%d,%d,%d\n" % r for r in rows).encode()).hexdigest()
        best[:, d] = min(rows, key=lambda r: (-r[1], r[0], r[2]))
    return n_runs, best, digests, collapsed


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", change=None) -> DataFrame:
    """Per document: number of runs, its longest run, digests of all runs and of the rest.

    Of words inside runs only the first period of each run is left. ``change`` may put
    other words of a block in place of its own (``repeated_words``).
    """

    names = [f.name for f in StructType.fromDDL(FIELDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, data, offsets in text_blocks(batch.column(1)):
                some = ids[first : first + len(offsets) - 1]
                n_runs, best, digests, collapsed = _block_rows(Block(data, offsets), some, change)
                start, length, period = best
                gone = n_runs == 0
                exponent = 1000 * length // np.where(gone, 1, period)
                columns = [pa.array(some, pa.int64()), pa.array(n_runs)]
                columns += [pa.array(x, pa.int64(), mask=gone) for x in (start, length, period, exponent)]
                columns += [pa.array(digests, pa.string()), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    arrow_limits(docs.sparkSession)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").cast("string").alias("t"))
    return source.mapInArrow(run, FIELDS)


def query(spark, folder):
    """Runs of all documents, those with a tenth of the digests made periodic."""
    return periodic_runs(spark.read.parquet(f"{folder}/documents.parquet"), change=repeated_words)
