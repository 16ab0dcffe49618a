"""Substring dedup by compaction of a de Bruijn graph of words.

Edges are the windows of ``WIDTH`` words, nodes the ``WIDTH - 1`` words that neighbouring
windows share. Edges that occur in one document alone play no part. Paths of repeated edges
without branches are compacted, each path is known by its first source, and a document loses
the words of every path that an earlier document (smaller id) has, too.

A row for each window of the corpus would be many times the input, so windows stay together:

* the ``GRAM``-word string with the smallest hash in a window (the leftmost, if several) is
  its anchor. Neighbouring windows with one anchor form a run, which is named by a hash.
  Equal windows have equal anchors, so only runs with one anchor can share windows;
* anchors of one document alone are dropped. A filter of fixed size keeps most of their runs
  out of the exchange, a join the rest. Equal runs are combined before they are shuffled;
* an anchor with one run is an edge of several windows; the runs of an anchor with several
  are cut into windows, read again from their first source. Windows are counted by a
  grouping with map-side combine, so no key is gathered in one task;
* nodes are counted; edges join at nodes with one edge in and one out, first seen in the same
  document, and follow each other there: that is a path, with an offset for each edge;
* the edges' paths go back to all runs by a join, and to each document as spans; spans that
  follow each other on a path are one;
* every span is verified by its source coordinates: the words of the document and those of
  the source, read from both texts, must have one digest. Spans that fail are left alone.

Defined results:

* null or empty text: no words; fewer than ``WIDTH`` words: nothing removed;
* null ``doc_id``: neither a source nor cut; rows of one id are no sources of each other;
  rows equal in id and text get equal results;
* very long texts are worked out whole, as one block;
* an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kohorta.llm.bits import filter_of, passes
from kohorta.llm.frames import arrow_limits, map_texts, texts_of
from kohorta.llm.joined import joined_digests
from kohorta.llm.suffix_dedup import _sliding_minimum
from kohorta.llm.wordbytes import _LANES, _ODD, Block, mix, shingles, text_blocks
from kohorta.session import cut_lineage

WIDTH, GRAM = 13, 4
_LOW = np.uint64(0xFFFFFFFF)


def _by_place(words: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on; the largest value where they don't fit."""
    out = np.full(len(words) + 1, np.iinfo(np.uint64).max, np.uint64)
    _, at, value = shingles(words, doc, size)
    out[at] = value
    return out


def _hashes_at(words: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the strings of ``size`` words at some places, as ``_by_place`` gives them."""
    value = np.full(len(places), size, np.uint64) * _ODD
    for k in range(size):
        value += words[places + k] * _LANES[k]
    return mix(value)


def window_runs(block: Block, width: int, named: bool = True, nodes: bool = True):
    """``(text, first window, windows, anchor, run, first node, last node)`` of all runs.

    Places are words of the text; the last four are hashes. The last three are worked out
    only if they are asked for.
    """
    words, none = block.word_hashes(), np.zeros(0, np.uint64)
    at = np.flatnonzero(block.doc[width - 1 :] == block.doc[: max(len(words) - width + 1, 0)])
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (none,) * 4
    grams = _by_place(words, block.doc, GRAM)
    keyed = (grams[:-1] & ~_LOW) | np.arange(len(words), dtype=np.uint64)
    anchor = (_sliding_minimum(keyed, width - GRAM + 1)[at] & _LOW).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(at)])
    begin = np.searchsorted(block.doc, np.arange(block.n))
    start, doc = at[first], block.doc[at[first]]
    run = u = v = none
    if named:
        inside = np.arange(len(at)) - np.repeat(first, n)
        window = _hashes_at(words, at, width)
        run = mix(np.add.reduceat(mix(window + inside.astype(np.uint64) * _ODD), first))
    if nodes:
        u, v = (_hashes_at(words, places, width - 1) for places in (start, start + n))
    return doc, start - begin[doc], n, grams[anchor[first]], run, u, v


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(whole).alias("digest"), whole.alias("text"))


def _mapped_runs(source: DataFrame, width: int, rows, schema: str, **asked: bool) -> DataFrame:
    """``rows(ids, digests, runs)`` of the runs of each batch of documents that have an id."""
    arrow_limits(source.sparkSession)
    names = [f.name for f in StructType.fromDDL(schema)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            parts = []
            for first, data, offsets in text_blocks(batch.column(2)):
                doc, *runs = window_runs(Block(data, offsets), width, **asked)
                parts.append((first + doc, *runs))
            if not sum(len(part[0]) for part in parts):
                continue
            doc, *runs = (np.concatenate(column) for column in zip(*parts, strict=True))
            columns = rows(ids[doc], digests[doc], *runs)
            signed = [c.view(np.int64) if c.dtype == np.uint64 else c for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in signed], names=names)

    return source.filter("doc_id IS NOT NULL").mapInArrow(work, schema)


def _groups(key: np.ndarray) -> np.ndarray:
    """First place of each stretch of equal values."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.flatnonzero(new)


def repeated_anchors(source: DataFrame, width: int) -> DataFrame:
    """Anchors ``a`` that at least two documents have; stored."""

    def rows(ids, digests, start, n, anchor, run, u, v):
        order = np.argsort(anchor, kind="stable")
        first = _groups(anchor[order])
        low, high = (f.reduceat(ids[order], first) for f in (np.minimum, np.maximum))
        return anchor[order][first], low, high

    seen = _mapped_runs(source, width, rows, "a long, low long, high long", named=False, nodes=False).groupBy("a")
    seen = seen.agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return cut_lineage(seen.filter("low < high").select("a"), "debruijn-anchors")


FIRST = ("low", "digest", "start")


def distinct_runs(source: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    """Each run of a repeated anchor once, with its first source and the largest id; stored."""
    bits = source.sparkSession.sparkContext.broadcast(filter_of(anchors, "a"))

    def rows(ids, digests, start, n, anchor, run, u, v):
        some = np.flatnonzero(passes(bits.value, anchor))
        some = some[np.lexsort((start[some], digests[some], ids[some], run[some]))]
        first = _groups(run[some])
        at = some[first]
        high = np.maximum.reduceat(ids[some], first) if len(some) else ids[at]
        return tuple(c[at] for c in (anchor, run, u, v, n, ids, digests, start)) + (high,)

    schema = "a long, s long, u long, v long, n long, low long, digest long, start long, high long"
    runs = _mapped_runs(source, width, rows, schema).groupBy("a", "s").agg(
        F.min(F.struct(*FIRST, "n", "u", "v")).alias("x"), F.max("high").alias("high")
    )
    return cut_lineage(runs.select("a", "s", "x.*", "high").join(anchors.hint("merge"), "a", "left_semi"), "debruijn-runs")


WANTED = "s long, start long, n long, high long"


def cut_windows(docs: DataFrame, runs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """The windows of ``runs``, read from their first sources; stored."""
    wanted = F.collect_list(F.struct("s", "start", "n", "high")).alias("wanted")
    asked = runs.groupBy(F.col("low").alias("doc_id"), F.col("digest").alias("text_hash")).agg(wanted)
    asked = asked.select("*", F.lit(0).alias("row"), F.col("doc_id").alias("low"), F.col("text_hash").alias("digest"))
    found = texts_of(docs, asked, "row", doc_id, text).select("text", "wanted", "low", "digest")
    schema = "s long, k long, e long, u long, v long, low long, digest long, start long, high long"
    names = [f.name for f in StructType.fromDDL(schema)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, digest = (batch.column(i).to_numpy() for i in (2, 3))
            lists = batch.column(1)
            bounds = lists.offsets.to_numpy()
            s, start, n, high = (f.to_numpy() for f in lists.values.flatten())
            for first, data, offsets in text_blocks(batch.column(0)):
                block = Block(data, offsets)
                words = block.word_hashes()
                windows, nodes = (_by_place(words, block.doc, size) for size in (width, width - 1))
                some = slice(bounds[first], bounds[first + block.n])
                own = np.repeat(np.arange(block.n), np.diff(bounds[first : first + block.n + 1]))
                begin = np.searchsorted(block.doc, np.arange(block.n))
                many = n[some]
                back = np.repeat(np.arange(len(many)), many)
                k = np.arange(len(back)) - np.repeat(np.cumsum(many) - many, many)
                place = start[some][back] + k
                at = begin[own[back]] + place
                columns = [s[some][back], k, windows[at].view(np.int64), nodes[at].view(np.int64), nodes[at + 1].view(np.int64),
                           low[first + own[back]], digest[first + own[back]], place, high[some][back]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return cut_lineage(found.mapInArrow(work, schema), "debruijn-windows")


def compact(edges: DataFrame) -> DataFrame:
    """``edges`` with ``begin``, the place in their first source where their path begins.

    Edges ``e, n, u, v`` with first source ``low, digest, start``. Two are joined at a node
    with one edge in and one out if both come from one source and follow each other in it.
    """
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out"), "low"),
        F.struct(F.col("v").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out"), "low"),
    )
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(
        F.sum("into").alias("into"), F.sum("out").alias("out"), F.min("low").alias("a"), F.max("low").alias("b")
    )
    smooth = nodes.filter("into = 1 AND out = 1 AND a = b").select(F.col("node").alias("v"), F.lit(True).alias("goes_on"))
    source = Window.partitionBy("low", "digest").orderBy("start")
    follows = F.lag("goes_on").over(source) & (F.lag(F.col("start") + F.col("n")).over(source) == F.col("start"))
    begins = F.when(~F.coalesce(follows, F.lit(False)), F.col("start"))
    begin = F.last("begins", ignorenulls=True).over(source.rowsBetween(Window.unboundedPreceding, 0))
    joined = edges.join(smooth, "v", "left").withColumn("begins", begins)
    return joined.select("e", "n", *FIRST, begin.alias("begin"))


def paths_of_runs(docs: DataFrame, runs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """``s`` and ``parts``: the repeated edges of each run with their paths; stored."""
    several = runs.groupBy("a").count().filter("count > 1").select("a")
    alone = runs.join(several, "a", "left_anti").filter("low < high")
    windows = cut_windows(docs, runs.join(several, "a", "left_semi"), width, doc_id, text)
    repeated = windows.groupBy("e").agg(F.min(F.struct(*FIRST, "u", "v")).alias("x"), F.max("high").alias("high"))
    repeated = repeated.select("e", F.lit(1).cast("long").alias("n"), "x.*", "high").filter("low < high")
    edges = alone.select(F.struct(F.lit(True).alias("whole"), F.col("s").alias("h")).alias("e"), "n", "u", "v", *FIRST).unionByName(
        repeated.select(F.struct(F.lit(False).alias("whole"), F.col("e").alias("h")).alias("e"), "n", "u", "v", *FIRST)
    )
    paths = cut_lineage(compact(edges), "debruijn-paths")
    part = F.struct("k", "n", *FIRST, "begin")
    none = F.lit(0).cast("long").alias("k")
    of_alone = paths.filter("e.whole").select(F.col("e.h").alias("s"), none, "n", *FIRST, "begin")
    of_windows = paths.filter("NOT e.whole").select(F.col("e.h").alias("e"), "n", *FIRST, "begin")
    of_windows = windows.select("s", "k", "e").join(of_windows, "e").drop("e")
    together = of_alone.select("s", F.array(part).alias("parts")).unionByName(
        of_windows.groupBy("s").agg(F.collect_list(part).alias("parts"))
    )
    return cut_lineage(together, "debruijn-parts")


SPAN = "struct<start: long, n: long, low: long, digest: long, source: long>"


def document_spans(source: DataFrame, parts: DataFrame, width: int) -> DataFrame:
    """``doc_id, digest, spans``: what earlier documents have, too, as windows; stored.

    A span of ``n`` windows from ``start`` on lies on one path and equals the ``n`` windows
    from ``source`` on in the document ``low, digest``.
    """
    bits = source.sparkSession.sparkContext.broadcast(filter_of(parts, "s"))

    def rows(ids, digests, start, n, anchor, run, u, v):
        some = passes(bits.value, run)
        return run[some], ids[some], digests[some], start[some]

    own = _mapped_runs(source, width, rows, "s long, doc_id long, own long, first long", nodes=False)
    known = own.join(parts.hint("merge"), "s").select("doc_id", "own", "first", F.inline("parts")).filter("low < doc_id")
    piece = F.struct((F.col("first") + F.col("k")).alias("start"), "n", "low", "digest", F.col("start").alias("source"), "begin")
    listed = known.groupBy("doc_id", "own").agg(F.array_sort(F.collect_set(piece)).alias("pieces"))
    schema = f"doc_id long, digest long, spans array<{SPAN}>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy()
            start, n, low, digest, at, begin = (f.to_numpy() for f in lists.values.flatten())
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            new = np.ones(len(start), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1]) | (at[1:] != at[:-1] + n[:-1])
            for x in (low, digest, begin):
                new[1:] |= x[1:] != x[:-1]
            first = np.flatnonzero(new)
            total = np.add.reduceat(n, first) if len(first) else n
            spans = pa.StructArray.from_arrays(
                [pa.array(x) for x in (start[first], total, low[first], digest[first], at[first])],
                names=["start", "n", "low", "digest", "source"],
            )
            edge = np.searchsorted(doc[first], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(edge), spans)], names=["doc_id", "digest", "spans"]
            )

    return cut_lineage(listed.mapInArrow(work, schema), "debruijn-spans")


SHOWN = "struct<low: long, digest: long, source: long, n: long, hash: string>"
CUT = f"doc_id long, digest long, n_removed long, kept_sha256 string, shown array<{SHOWN}>"


def cut_documents(docs: DataFrame, spans: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """Result of each document with spans, and digests ``shown`` of spans and of their sources; stored."""
    asked = spans.select(F.inline("spans")).select(F.col("low").alias("doc_id"), "digest", "source", "n").distinct()
    own = F.flatten(F.collect_list("spans")).alias("spans")
    both = spans.unionByName(
        asked.groupBy("doc_id", "digest").agg(
            F.collect_list(F.struct(F.col("source").alias("start"), "n", "doc_id", "digest", "source").cast(SPAN)).alias("spans")
        )
    ).groupBy("doc_id", "digest").agg(own)
    wanted = both.select("doc_id", F.col("digest").alias("text_hash"), F.lit(0).alias("row"), "spans", F.col("doc_id").alias("id"), F.col("digest").alias("own"))
    found = texts_of(docs, wanted, "row", doc_id, text).select("text", "spans", "id", "own")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, owns = (batch.column(i).to_numpy() for i in (2, 3))
            lists = batch.column(1)
            bounds = lists.offsets.to_numpy()
            start, n, low, digest, at = (f.to_numpy() for f in lists.values.flatten())
            for first, data, offsets in text_blocks(batch.column(0)):
                block = Block(data, offsets)
                some = slice(bounds[first], bounds[first + block.n])
                own = np.repeat(np.arange(block.n), np.diff(bounds[first : first + block.n + 1]))
                begin = np.searchsorted(block.doc, np.arange(block.n))[own] + start[some]
                end = begin + n[some] + width - 1
                goes = low[some] < ids[first + own]
                marks = np.zeros(len(block.starts) + 1, np.int64)
                np.add.at(marks, begin[goes], 1)
                np.add.at(marks, end[goes], -1)
                kept = np.cumsum(marks)[:-1] == 0
                removed = block.count(block.doc[~kept])
                take = np.flatnonzero(kept)
                digests = joined_digests(block, take, block.doc[take])
                shown = [_words_digest(block, i, j) for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
                rows = pa.StructArray.from_arrays(
                    [pa.array(x[some]) for x in (low, digest, at, n)] + [pa.array(shown, pa.string())],
                    names=["low", "digest", "source", "n", "hash"],
                )
                edge = (bounds[first : first + block.n + 1] - bounds[first]).astype(np.int32)
                columns = [pa.array(ids[first : first + block.n]), pa.array(owns[first : first + block.n]), pa.array(removed),
                           pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(edge), rows)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n_removed", "kept_sha256", "shown"])

    return cut_lineage(found.mapInArrow(work, CUT), "debruijn-cut")


def _words_digest(block: Block, first: int, end: int) -> str:
    """Digest of words ``first:end`` whatever white space stands between them."""
    raw = block.data[block.starts[first] : block.ends[end - 1]]
    word = block.word_byte[block.starts[first] : block.ends[end - 1]]
    keep = word.copy()
    keep[1:] |= word[:-1]
    return hashlib.md5(np.where(word, raw, np.uint8(32))[keep].tobytes()).hexdigest()


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id, digest, spans`` of the documents that share windows with earlier ones."""
    source = _source(docs, doc_id, text)
    runs = distinct_runs(source, repeated_anchors(source, width), width)
    return document_spans(source, paths_of_runs(docs, runs, width, doc_id, text), width)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: its words, how many of them go, digest of those kept."""
    spans = repeated_spans(docs, doc_id, text, width)
    key = ["low", "digest", "source", "n"]
    while True:
        cut = cut_documents(docs, spans, width, doc_id, text)
        wrong = cut.select(F.inline("shown")).groupBy(*key).agg(F.min("hash").alias("a"), F.max("hash").alias("b"))
        wrong = wrong.filter("a <> b").select(*key)
        if wrong.isEmpty():
            break
        rows = spans.select("doc_id", F.col("digest").alias("own"), F.inline("spans")).join(wrong, key, "left_anti")
        spans = rows.groupBy("doc_id", F.col("own").alias("digest")).agg(
            F.array_sort(F.collect_list(F.struct("start", "n", "low", F.col("digest"), "source"))).alias("spans")
        )
        spans = cut_lineage(spans, "debruijn-spans")

    def whole(column: pa.Array) -> list[pa.Array]:
        counts, digests = [np.zeros(0, np.int64)], []
        for _, data, offsets in text_blocks(column):
            block = Block(data, offsets)
            counts.append(block.count(block.doc))
            digests += joined_digests(block, np.arange(len(block.starts)), block.doc)
        return [pa.array(np.concatenate(counts)), pa.array(digests, pa.string())]

    fields = StructType.fromDDL("n_words long, whole string")
    rows = map_texts(_source(docs, doc_id, text), "text", ["doc_id", "digest"], fields, whole)
    removed = F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed")
    return rows.join(cut.drop("shown"), ["doc_id", "digest"], "left").select(
        "doc_id", "n_words", removed, F.coalesce("kept_sha256", "whole").alias("kept_sha256")
    )


def query(spark, folder):
    """Documents without the passages that earlier ones have."""
    return remove_repeats(spark.read.parquet(f"{folder}/documents.parquet"))


SQL = r"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
place AS (
  SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM split WHERE len(words) >= 13),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS w FROM place),
first AS (SELECT w, min(doc_id) AS low FROM win GROUP BY w),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS j
  FROM win JOIN first USING (w) WHERE low < doc_id),
lost AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN js IS NULL THEN words ELSE
         list_transform(list_filter(list_zip(words, generate_series(1, len(words))), lambda x: NOT list_contains(js, x[2])), lambda x: x[1])
       END, ' '), '')) AS kept_sha256
FROM split LEFT JOIN lost USING (doc_id)"""
