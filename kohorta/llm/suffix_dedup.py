"""Suffix-array dedup: remove every byte of a long string that occurs elsewhere.

A byte goes if it is covered by a string of ``length`` bytes that starts at another
place, too, in the same or another text, all judged on the input. Texts are UTF-8 bytes.

A suffix array of the whole corpus would be one task's work, so suffixes are dealt out by
content first. Of the ``length`` bytes of a window, the ``GRAM``-byte string with the
smallest hash (the leftmost, if several) is its anchor. Equal windows have equal anchors at
equal places, so windows are compared only with those of the same anchor:

* neighbouring windows with one anchor form a run, and the bytes of a run one string;
* anchors that occur once are dropped, equal strings are counted and kept once;
* the strings of an anchor meet in one task, aligned at the anchor and cut into symbols of
  ``STEP`` bytes. A suffix array of the symbols is built by linear grouping
  (``suffix_array``); suffixes that share their symbols are neighbours in it, and of these
  the same bytes before and behind the symbols show which windows occur more than once;
* the ranges of these windows go back to all runs with that string.

An anchor with more than ``HOT`` different strings (a passage that very many texts quote) is
not sorted in one task. Its windows are taken in classes: the windows that start at
``CLASS`` neighbouring distances from the anchor share all but ``CLASS - 1`` bytes, and the
hash of these is their key. Beyond the edges of a passage a class is alone and drops out,
inside it all pieces of a class are equal; only where they differ, at its edges, windows are
counted one by one. All of that are counts of hashes, combined before they are dealt out, so
no task grows with the number of texts that quote a passage.

Defined results:

* null or empty text, or one shorter than ``length``: nothing removed;
* null ``doc_id`` and equal ids: each row is a text of its own; rows equal in id and text
  get equal results and count as repeats of each other;
* very long texts are cut into overlapping tiles, so no window is missed;
* an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kohorta.llm.frames import map_texts, texts_of
from kohorta.llm.suffix_array import suffix_array
from kohorta.llm.wordbytes import _BASE, _BYTE_VALUES, _INVERSE, _ODD, _power, mix, text_blocks
from kohorta.session import cut_lineage

LENGTH, GRAM, STEP, CLASS, HOT = 400, 16, 32, 16, 4096
TILE, BATCH_BYTES = 1 << 20, 1 << 20
_LOW = np.uint64(0xFFFFFFFF)


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _power(_BASE, len(data), "up"), dtype=np.uint64, out=out[1:])
    return out


def _hash(sums: np.ndarray, start, end) -> np.ndarray:
    """Hash of the bytes from ``start`` to ``end``, equal for equal bytes."""
    down = _power(_INVERSE, len(sums), "down")
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by running minima of blocks from both ends."""
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    head = np.minimum.accumulate(blocks, 1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[: len(x) - width + 1], head[width - 1 : len(x)])


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """``(text, first window, windows, distance of the anchor, anchor, string)`` of all runs.

    ``anchor`` and ``string`` are hashes.
    """
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    sums = _sums(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = _hash(sums, at, at + GRAM)
    keyed = (grams & ~_LOW) | at.astype(np.uint64)
    anchor = (_sliding_minimum(keyed, length - GRAM + 1) & _LOW).astype(np.int64)
    p = np.arange(len(anchor))
    doc = np.searchsorted(offsets[1:], p, "right")
    inside = p + length <= offsets[np.minimum(doc + 1, len(offsets) - 1)]
    p, doc, anchor = p[inside], doc[inside], anchor[inside]
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(p)])
    start, anchor, doc = p[first], anchor[first], doc[first]
    return doc, start - offsets[doc], n, anchor - start, grams[anchor], _hash(sums, start, start + n + length - 1)


def _tiles(data: np.ndarray, offsets: np.ndarray, length: int):
    """``(text, start in it, bytes, offsets)``: blocks, and long texts in overlapping tiles."""
    if len(offsets) > 2 or len(data) <= 2 * TILE:
        yield 0, 0, data, offsets
        return
    for at in range(0, len(data) - length + 1, TILE):
        part = data[at : at + TILE + length - 1]
        yield 0, at, part, np.array([0, len(part)])


ROW = "uid long, n_bytes long, sha256 string, runs array<struct<p: long, last: long, n: int, d: int, m: int, a: long, s: long>>"


def run_rows(docs: DataFrame, length: int, doc_id: str, text: str) -> DataFrame:
    """Per document, written: row id, size and digest of its bytes, its runs.

    Runs with equal strings that follow each other, as in periodic text, are one entry
    from ``p`` to ``last`` with ``m`` occurrences.
    """
    place = [0]

    def work(column: pa.Array) -> list[pa.Array]:
        rows, parts = len(column), []
        sizes, digests = np.zeros(rows, np.int64), []
        for first, data, offsets in text_blocks(column):
            sizes[first : first + len(offsets) - 1] = np.diff(offsets)
            raw = memoryview(np.ascontiguousarray(data))
            digests += [hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            for row, shift, part, bounds in _tiles(data, offsets, length):
                doc, p, n, d, a, s = window_runs(part, bounds, length)
                parts.append((doc + first + row, p + shift, n, d, a.view(np.int64), s.view(np.int64)))
        doc, p, n, d, a, s = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 6
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1]) | (a[1:] != a[:-1])
        new[1:] |= p[1:] > p[:-1] + n[:-1] + length - 1
        first = np.flatnonzero(new)
        many = np.diff(np.r_[first, len(doc)])
        last = p[np.r_[first[1:], len(doc)] - 1] if len(doc) else p
        entries = pa.StructArray.from_arrays(
            [pa.array(p[first]), pa.array(last), pa.array(n[first].astype(np.int32)), pa.array(d[first].astype(np.int32)),
             pa.array(many.astype(np.int32)), pa.array(a[first]), pa.array(s[first])],
            names=["p", "last", "n", "d", "m", "a", "s"],
        )
        edge = np.searchsorted(doc[first], np.arange(rows + 1))
        uid = (TaskContext.get().partitionId() << 40) + place[0] + np.arange(rows)
        place[0] += rows
        return [pa.array(uid), pa.array(sizes), pa.array(digests, pa.string()),
                pa.ListArray.from_arrays(pa.array(edge, pa.int32()), entries)]

    source = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        F.xxhash64(F.col(text).cast("string")).alias("text_hash"),
    )
    mapped = map_texts(source, "text", ["doc_id", "text_hash"], StructType.fromDDL(ROW), work)
    return cut_lineage(mapped, "suffix-rows")


def repeated_windows(strings: list[bytes], distance: list[int], weight: np.ndarray, length: int):
    """``(string, start)`` of the windows that occur more than once among weighted strings.

    The strings may have several anchors; those of one anchor are cut into symbols at equal
    places relative to it.
    """
    data = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    start = np.cumsum(size) - size
    phase = np.array(distance) % STEP
    many = np.maximum((size - phase) // STEP, 0)
    owner = np.repeat(np.arange(len(strings)), many)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    at = start[owner] + phase[owner] + step * STEP
    sums = _sums(data)
    symbol = _hash(sums, at, at + STEP)
    rank = np.unique(symbol, return_inverse=True)[1] + 2
    places = np.arange(len(owner)) + owner + 1
    text = np.ones(len(owner) + len(strings), np.int64)
    text[places] = rank
    back = np.full(len(text), -1)
    back[places] = np.arange(len(owner))
    order = back[np.array(suffix_array(text.tolist()), np.int64)]
    order = order[order >= 0]

    left, right = order[:-1], order[1:]
    ends = (start + size)[owner]
    common = np.zeros(len(left), np.int64)
    going = np.arange(len(left))
    for k in range(-(-length // STEP)):
        i, j = left[going] + k, right[going] + k
        fits = (step[left[going]] + k < many[owner[left[going]]]) & (step[right[going]] + k < many[owner[right[going]]])
        i, j, going = i[fits], j[fits], going[fits]
        same = symbol[i] == symbol[j]
        going = going[same]
        common[going] += STEP
    found = []
    place, who = at[order], owner[order]
    for before in range(STEP):
        need = length - before
        symbols = need // STEP * STEP
        whole = (place - before >= start[who]) & (place + need <= ends[order])
        cut = np.ones(len(order), bool)
        cut[1:] = common < symbols
        interval = np.cumsum(cut)
        total = np.bincount(interval, weight[who] * whole, minlength=len(order) + 1)
        some = np.flatnonzero(whole & (total[interval] >= 2))
        if len(some):
            # Within the interval of equal symbols: the bytes before them and behind them.
            key = mix(interval[some].astype(np.uint64))
            key = mix(key + _hash(sums, place[some] - before, place[some]))
            key = mix(key + _hash(sums, place[some] + symbols, place[some] + need))
            inverse = np.unique(key, return_inverse=True)[1]
            some = some[np.bincount(inverse, weight[who[some]])[inverse] >= 2]
        found.append((who[some], place[some] - before - start[who[some]]))
    who, begin = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((begin, who))
    return who[order], begin[order]


def covered_ranges(who: np.ndarray, begin: np.ndarray, length: int):
    """``(string, from, to)``: unions of windows, which come sorted."""
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (begin[1:] > begin[:-1] + length)
    first = np.flatnonzero(new)
    last = np.r_[first, len(who)][1:] - 1
    return who[first], begin[first], begin[last] + length


STRING = "a long, s long, w long, d int, bytes binary"


def _cut_strings(length: int):
    """Strings of the runs that stand for all equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                out += [(r["a"], r["s"], r["w"], r["d"], raw[r["p"] : r["p"] + r["n"] + length - 1]) for r in runs]
            for at in range(0, len(out), 20_000):
                columns = list(zip(*out[at : at + 20_000], strict=True))
                kinds = [pa.int64()] * 3 + [pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["a", "s", "w", "d", "bytes"]
                )

    return run


CLASSES = "a long, s long, w long, k long, piece long, far int, shift int, windows array<long>"


def _cut_classes(length: int):
    """Windows of hot strings in classes: hash of what a class shares, of its piece, of each window."""

    def batch_of(strings):
        whose, parts, hashes = [], [], []
        for a, s, w, d, n, piece in strings:
            sums = _sums(np.frombuffer(piece, np.uint8))
            # Window q of the string starts d - q bytes before the anchor.
            low, high = d - n + 1, d
            c = np.arange(high // CLASS, low // CLASS - 1, -1)
            near, far = np.maximum(low, c * CLASS), np.minimum(high, c * CLASS + CLASS - 1)
            core = d - c * CLASS
            key = mix(_hash(sums, core, core + length - CLASS + 1) + c.astype(np.uint64))
            whole = mix(_hash(sums, d - far, d - near + length) + far.astype(np.uint64))
            at = np.arange(n)
            hashes.append(_hash(sums, at, at + length).view(np.int64))
            parts.append((key.view(np.int64), whole.view(np.int64), far, d - far, far - near + 1))
            whose += [(a, s, w)] * len(c)
        key, whole, far, shift, many = (np.concatenate(x) for x in zip(*parts, strict=True))
        edge = pa.array(np.r_[0, np.cumsum(many)].astype(np.int32))
        windows = pa.ListArray.from_arrays(edge, pa.array(np.concatenate(hashes)))
        return pa.RecordBatch.from_arrays(
            [*(pa.array(x, pa.int64()) for x in zip(*whose, strict=True)), pa.array(key), pa.array(whole),
             pa.array(far.astype(np.int32)), pa.array(shift.astype(np.int32)), windows],
            names=["a", "s", "w", "k", "piece", "far", "shift", "windows"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                for r in runs:
                    piece = raw[r["p"] : r["p"] + r["n"] + length - 1]
                    out.append((r["a"], r["s"], r["w"], r["d"], r["n"], piece))
            for at in range(0, len(out), 1_000):
                yield batch_of(out[at : at + 1_000])

    return run


def hot_marks(classes: DataFrame, length: int) -> DataFrame:
    """Repeated ranges ``a, s, lo, hi`` of hot strings; ``classes`` is stored, as it is read twice."""
    some = classes.groupBy("a", "k").agg(
        F.sum("w").alias("all"), (F.min("piece") != F.max("piece")).alias("mixed")
    )
    met = cut_lineage(classes.join(some.filter("`all` > 1").drop("all"), ["a", "k"]), "suffix-classes-met")
    lo = F.col("shift").cast("long")
    whole = met.filter("not mixed").select("a", "s", lo.alias("lo"), (lo + F.size("windows") - 1 + length).alias("hi"))
    single = met.filter("mixed").select("a", "s", "w", "k", "far", "shift", F.posexplode("windows").alias("i", "h"))
    single = single.select("a", "s", "w", "k", "h", (F.col("far") - F.col("i")).alias("d"), (lo + F.col("i")).alias("lo"))
    twice = single.groupBy("a", "k", "d", "h").agg(F.sum("w").alias("all")).filter("`all` > 1").drop("all")
    found = single.join(twice, ["a", "k", "d", "h"]).select("a", "s", "lo", (F.col("lo") + length).alias("hi"))
    return whole.unionByName(found)


def _mark(length: int):
    """Repeated ranges of the strings, sorted by anchor, a batch of whole anchors at a time.

    Equal strings of one anchor are one weighted string, so a batch grows with what differs.
    """

    def ranges(groups):
        strings, distance, weight, back = [], [], [], []
        for pieces in groups:
            for (piece, d), rows in pieces.items():
                strings.append(piece)
                distance.append(d)
                weight.append(sum(r[2] for r in rows))
                back.append(rows)
        who, begin = repeated_windows(strings, distance, np.array(weight, float), length)
        out = []
        for i, lo, hi in zip(*(x.tolist() for x in covered_ranges(who, begin, length)), strict=True):
            out += [(a, s, lo, hi) for a, s, _ in back[i]]
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["a", "s", "lo", "hi"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key, pieces = [], 0, None, {}
        for batch in batches:
            a, s, w, d = (batch.column(i).to_pylist() for i in range(4))
            for i, piece in enumerate(batch.column(4)):
                if a[i] != key:
                    if sum(r[2] for rows in pieces.values() for r in rows) > 1:
                        held.append(pieces)
                    else:
                        size -= sum(len(p) for p, _ in pieces)
                    key, pieces = a[i], {}
                    if size > BATCH_BYTES:
                        yield from ranges(held)
                        held, size = [], 0
                piece = piece.as_py()
                if (piece, d[i]) not in pieces:
                    size += len(piece)
                pieces.setdefault((piece, d[i]), []).append((a[i], s[i], w[i]))
        held.append(pieces)
        if pieces or len(held) > 1:
            yield from ranges([p for p in held if p])

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text"):
    """``(rows, ranges)``: written rows of all documents, and ``uid, lo, hi`` of repeated bytes."""
    rows = run_rows(docs, length, doc_id, text)
    runs = rows.select("uid", F.explode("runs").alias("r")).select("uid", "r.*")
    strings = runs.groupBy("a", "s").agg(F.sum("m").alias("w"), F.min(F.struct("uid", "p", "n", "d")).alias("one"))
    strings = cut_lineage(strings, "suffix-strings")
    met = cut_lineage(
        strings.groupBy("a").agg(F.sum("w").alias("all"), F.count("*").alias("kinds")).filter("`all` > 1"),
        "suffix-anchors",
    )
    shared = strings.join(met, "a").select("a", "s", "w", "kinds", "one.*")

    def cut(chosen, work, made):
        asked = chosen.groupBy("uid").agg(F.collect_list(F.struct("a", "s", "w", "p", "n", "d")).alias("runs"))
        asked = cut_lineage(asked.join(rows.select("uid", "doc_id", "text_hash"), "uid"), "suffix-asked")
        texts = texts_of(docs, asked, "uid", doc_id, text)
        return texts.select("text", "runs").mapInArrow(work, made)

    dealt = cut(shared.filter(F.col("kinds") <= HOT), _cut_strings(length), STRING).repartition("a")
    found = dealt.sortWithinPartitions("a", "s").mapInArrow(_mark(length), "a long, s long, lo long, hi long")
    marks = cut_lineage(found, "suffix-marks")
    classes = cut_lineage(cut(shared.filter(F.col("kinds") > HOT), _cut_classes(length), CLASSES), "suffix-classes")
    marks = marks.unionByName(hot_marks(classes, length))
    ranges = runs.select("uid", "p", "last", "a", "s").join(marks, ["a", "s"])
    return rows, ranges.select("uid", (F.col("p") + F.col("lo")).alias("lo"), (F.col("last") + F.col("hi")).alias("hi"))


RESULT = "uid long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for uid, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw, spans, kept, at = (text.as_py() or "").encode(), [], [], 0
            for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
                if spans and lo <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], hi)
                else:
                    spans.append({"start": lo, "end": hi})
            for s in spans:
                kept.append(raw[at : s["start"]])
                at = s["end"]
            kept.append(raw[at:])
            out.append((uid, sum(s["end"] - s["start"] for s in spans), spans, b"".join(kept)))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                names=["uid", "n_removed", "spans", "kept"],
            )


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text"):
    """``(rows, changed)``: all documents, and those that lose bytes.

    ``rows`` has ``uid, doc_id, n_bytes, sha256``; ``changed`` has ``uid, n_removed, spans``
    (byte ranges that went) and ``kept``, the remaining bytes, which may cut a character.
    """
    rows, ranges = repeated_ranges(docs, length, doc_id, text)
    listed = ranges.groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    asked = cut_lineage(listed.join(rows.select("uid", "doc_id", "text_hash"), "uid"), "suffix-changed")
    texts = texts_of(docs, asked, "uid", doc_id, text)
    return rows, texts.select("uid", "text", "ranges").mapInArrow(_remove, RESULT)


def query(spark, folder):
    rows, changed = remove_repeats(spark.read.parquet(f"{folder}/documents.parquet"))
    digests = changed.select(
        "uid", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
    return rows.select("uid", "doc_id", "n_bytes", "sha256").join(digests, "uid", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )
