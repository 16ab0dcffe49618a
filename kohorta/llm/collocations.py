"""Phrase collocations by FM-indexes of word ids, one for each shard of the texts.

Texts are lower-cased (A-Z), split at punctuation and line ends into pieces and those at
blanks into words. Everything is counted within a language. A phrase of 2 to ``DEPTH`` words
that occurs at least ``LEAST`` times is a candidate; its score compares its count with those
of the two parts of a cut, the lowest-scoring cut counts, and a candidate that lies in a
longer one of the same count is dropped.

* Words are counted first. Words of fewer than ``LEAST`` occurrences are in no candidate, so
  they part the pieces;
* each task makes an index of its texts, shard by shard (``SHARD_BYTES``): the
  Burrows-Wheeler transforms of the word ids and of their reverse, stored;
* intervals of patterns are extended to the right and to the left in turn. Phrases of two
  words are added up over all shards, then those of three whose both halves are frequent,
  then those of four and five, so that phrases that cannot be frequent are neither made nor
  shuffled. What is frequent reaches the tasks as a filter of fixed size (``bits``), which
  may let more pass, never less;
* most pairs of words are rare. Their counts are first added up by ``CELL_BITS`` bits of
  their hash, packed in blocks of neighbouring cells (three bytes a pair); a pair whose cell
  stays below ``LEAST`` is rare for certain, and only the others travel as phrases;
* scores are exact: products are decimals of 38 digits.

Counts cover all texts, whole. Defined results:

* null or empty text: no words; null ``lang``: ``und``, as if it were its name;
* ``doc_id`` plays no part: every row counts, repeated rows as often as they stand there;
* ties in the score: by count, then by phrase in byte order; tied cuts: the shortest first
  part;
* very long texts make a longer shard, and are never cut;
* an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.llm.bits import filter_of, passes
from kohorta.llm.frames import arrow_limits
from kohorta.llm.two_way_index import Patterns, TwoWayIndex
from kohorta.llm.wordbytes import _LANES, Block, mix, text_blocks
from kohorta.operators.skew import top_n
from kohorta.session import LARGE_ROWS, cut_lineage

LEAST, DEPTH, TOP = 100, 5, 2000
SHARD_BYTES = 4 << 20
CELL_BITS = 40
#: So many phrases of a block wait before they are added up.
ADD_ROWS = 1 << 18
#: What ends a piece.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[list(BREAKS)] = 10


class Pieces:
    """Words of a block of texts with their hashes and the pieces they stand in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.block = Block(_TABLE[data], offsets)
        ends = np.cumsum(self.block.data == 10)
        self.piece = (ends[self.block.starts] if len(ends) else self.block.starts) + self.block.doc
        self.hashes = in_language(self.block.word_hashes(), langs[self.block.doc])

    def words(self, some: np.ndarray) -> pa.Array:
        """The given words as strings."""
        size = (self.block.ends - self.block.starts)[some]
        end = np.cumsum(size)
        at = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(self.block.starts[some] - (end - size), size)
        offsets = np.r_[0, end].astype(np.int32)
        return pa.StringArray.from_buffers(len(some), pa.py_buffer(offsets), pa.py_buffer(self.block.data[at].tobytes()))


def in_language(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    return mix(words + langs)


def language_hashes(names: list[str]) -> np.ndarray:
    known = {n: int.from_bytes(hashlib.md5(n.encode()).digest()[:8], "little") for n in set(names)}
    return np.array([known[n] for n in names], np.uint64)


def phrase_hash(words: Iterable[np.ndarray]) -> np.ndarray:
    """Hash of phrases given as hashes of their first words, second words and so on."""
    out = np.uint64(0)
    for k, w in enumerate(words):
        out = out + (w * _LANES[k] + np.uint64(1))
    return mix(out)


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    arrow_limits(docs.sparkSession)
    return docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("t")
    )


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang, word, f`` of all words; a row without a word has the language's total."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            hashes = language_hashes(langs)
            for first, data, offsets in text_blocks(batch.column(1)):
                some = slice(first, first + len(offsets) - 1)
                found = Pieces(data, offsets, hashes[some])
                if not len(found.hashes):
                    continue
                _, at, n = np.unique(found.hashes, return_index=True, return_counts=True)
                own = pa.array(langs[some])
                names = own.take(pa.array(found.block.doc[at]))
                yield pa.RecordBatch.from_arrays([names, found.words(at), pa.array(n)], names=["lang", "word", "n"])
                totals = found.block.count(found.block.doc)
                yield pa.RecordBatch.from_arrays([own, pa.nulls(len(own), pa.string()), pa.array(totals)], names=["lang", "word", "n"])

    return texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def frequent_filter(phrases: DataFrame):
    """Broadcast filter of ``lang, phrase``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = language_hashes(batch.column(0).to_pylist())
            for first, data, offsets in text_blocks(batch.column(1)):
                block = Block(data, offsets)
                words = in_language(block.word_hashes(), langs[first : first + block.n][block.doc])
                begin = np.searchsorted(block.doc, np.arange(block.n))
                size = block.count(block.doc)
                out = np.zeros(block.n, np.uint64)
                for k in np.unique(size):
                    some = size == k
                    out[some] = phrase_hash([words[begin[some] + j] for j in range(k)])
                yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["h"])

    arrow_limits(phrases.sparkSession)
    keys = phrases.select("lang", "phrase").mapInArrow(hashed, "h long")
    return phrases.sparkSession.sparkContext.broadcast(filter_of(keys, "h"))


def piece_sequence(pieces: Pieces, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent words in order with 0 between pieces and for others, and their places.

    Words that stand alone between zeros are in no phrase and are left out.
    """
    keep = passes(frequent, phrase_hash([pieces.hashes]))
    begins = np.ones(len(keep), bool)
    begins[1:] = pieces.piece[1:] != pieces.piece[:-1]
    place = np.arange(len(keep)) + np.cumsum(begins)
    at = np.full(len(keep) + int(begins.sum()) + 1, -1)
    at[place[keep]] = np.flatnonzero(keep)
    word = at >= 0
    beside = np.zeros(len(at), bool)
    beside[1:] |= word[:-1]
    beside[:-1] |= word[1:]
    word &= beside
    at = at[word | np.r_[True, word[:-1]]]
    word = at >= 0
    out = np.zeros(len(at), np.uint64)
    out[word] = pieces.hashes[at[word]]
    return np.where(word, out, np.uint64(0)), at


SHARD = "words array<string>, langs array<string>, hashes binary, before binary, after binary"


def packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpacked(raw: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw.as_py()), kind)


def make_shards(texts: DataFrame, frequent) -> DataFrame:
    """One row for each shard: its words and the two transforms; stored."""

    def shard(parts: list) -> Iterator[pa.RecordBatch]:
        sequence = np.concatenate([np.zeros(1, np.uint64), *[p[0] for p in parts], np.zeros(1, np.uint64)])
        hashes, text = np.unique(sequence, return_inverse=True)
        if len(hashes) < 2:
            return
        known, first = np.unique(np.concatenate([p[1] for p in parts]), return_index=True)
        words = pa.concat_arrays([p[2] for p in parts]).take(pa.array(first))
        langs = pa.concat_arrays([p[3] for p in parts]).take(pa.array(first))
        index = TwoWayIndex.of(text, len(hashes))
        assert len(known) == len(hashes) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (words, langs)]
            + [pa.array([packed(x)]) for x in (hashes, index.before, index.after)],
            names=["words", "langs", "hashes", "before", "after"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            names = batch.column(0)
            hashes = language_hashes(names.to_pylist())
            for first, data, offsets in text_blocks(batch.column(1)):
                pieces = Pieces(data, offsets, hashes[first : first + len(offsets) - 1])
                sequence, at = piece_sequence(pieces, frequent.value)
                own, place = np.unique(sequence[at >= 0], return_index=True)
                place = at[at >= 0][place]
                langs = names.take(pa.array(pieces.block.doc[place] + first))
                parts.append((sequence, own, pieces.words(place), langs))
                size += len(data)
                if size >= SHARD_BYTES:
                    yield from shard(parts)
                    parts, size = [], 0
        if parts:
            yield from shard(parts)

    return cut_lineage(texts.mapInArrow(work, SHARD), "collocation-shards", **LARGE_ROWS)


def grown(index: TwoWayIndex, hashes: np.ndarray, filters: dict, longest: int) -> Iterator[Patterns]:
    """Patterns of 2, 3, ... numbers; those that a filter rules out are not extended."""

    def frequent(p: Patterns, first: int, size: int) -> np.ndarray:
        return passes(filters[size].value, phrase_hash(hashes[w] for w in p.words[first : first + size]))

    p = index.single()
    for k in range(2, longest + 1):
        p = index.extend_right(p) if k % 2 == 0 else index.extend_left(p)
        # What has just been added is at one end; the longest counted phrases there rule.
        size = min(k - 1, max(filters))
        if size > 1:
            p = p.only(frequent(p, k - size if k % 2 == 0 else 0, size))
        yield p
        if k in filters:
            p = p.only(frequent(p, 0, k))


def opened(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, TwoWayIndex]:
    """Hashes of the words of a shard and its index."""
    hashes = unpacked(batch.column(2)[row], np.uint64)
    return hashes, TwoWayIndex(*(unpacked(batch.column(c)[row], np.int32) for c in (3, 4)), len(hashes))


def blocks_of(shards: DataFrame) -> int:
    """Blocks that what shards send is dealt out by; they grow in number with the shards, so
    that a task that adds one up holds a bounded share."""
    return max(256, shards.count() // 4)


def likely_pairs(shards: DataFrame, least: int):
    """Broadcast filter of the pairs of words whose cells hold ``least`` occurrences.

    A row holds a shard's cells of one block, which ascend, as differences.
    """
    blocks = blocks_of(shards)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                hashes, index = opened(batch, row)
                p = index.extend_right(index.single())
                cell = (phrase_hash(hashes[w] for w in p.words) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
                order = np.argsort(cell)
                cell, size = cell[order], np.minimum(p.size[order].astype(np.int64), least).astype(np.uint32)
                block = cell // -(-(1 << CELL_BITS) // blocks)
                first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else block
                for i, j in zip(first.tolist(), [*first[1:].tolist(), len(block)], strict=True):
                    columns = [block[i : i + 1], [packed(np.diff(cell[i:j], prepend=0))], [packed(size[i:j])]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "cells", "sizes"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full(parts):
            cell = np.concatenate([np.cumsum(p[0]) for p in parts])
            size = np.concatenate([p[1] for p in parts])
            order = np.argsort(cell)
            cell, size = cell[order], size[order].astype(np.int64)
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            kept = cell[first][np.add.reduceat(size, first) >= least]
            return pa.RecordBatch.from_arrays([pa.array(kept << (64 - CELL_BITS))], names=["cell"])

        at, parts = None, []
        for batch in batches:
            for row, block in enumerate(batch.column(0).to_pylist()):
                if block != at and parts:
                    yield full(parts)
                    parts = []
                at = block
                parts.append((unpacked(batch.column(1)[row], np.int64), unpacked(batch.column(2)[row], np.uint32)))
        if parts:
            yield full(parts)

    sent = shards.mapInArrow(send, "block long, cells binary, sizes binary")
    cells = sent.repartition("block").sortWithinPartitions("block").mapInArrow(add, "cell long")
    return shards.sparkSession.sparkContext.broadcast(filter_of(cells, "cell"))


def phrase_counts(shards: DataFrame, filters: dict, shortest: int, longest: int, least: int, likely=None) -> DataFrame:
    """``lang, phrase, k, f`` of phrases of ``shortest`` to ``longest`` words with ``least`` occurrences.

    ``likely`` is a filter of the longest ones. A row that travels holds a shard's phrases of
    one language and one block of hashes; a block is added up by one task.
    """
    blocks = blocks_of(shards)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words, langs = batch.column(0)[row].values, batch.column(1)[row].values.dictionary_encode()
                hashes, index = opened(batch, row)
                lang_of = langs.indices.to_numpy()
                for p in grown(index, hashes, filters, longest):
                    if len(p.words) < shortest:
                        continue
                    key = phrase_hash(hashes[w] for w in p.words)
                    if likely and len(p.words) == longest:
                        some = passes(likely.value, key)
                        p, key = p.only(some), key[some]
                    group = lang_of[p.words[0] - 1] * np.int64(blocks) + (key % np.uint64(blocks)).astype(np.int64)
                    order = np.argsort(group, kind="stable")
                    p, group = p.only(order), group[order]
                    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else group
                    for at in range(0, len(first), 64):
                        edge = np.r_[first, len(group)][at : at + 65]
                        some = [words.take(pa.array(w[edge[0] : edge[-1]] - 1)) for w in p.words]
                        phrases = pc.binary_join_element_wise(*some, " ")
                        lists = pc.binary_join(pa.ListArray.from_arrays(pa.array(edge - edge[0], pa.int32()), phrases), "\n")
                        own = group[first[at : at + 64]]
                        sizes = [packed(p.size[i:j].astype(np.int64)) for i, j in zip(edge[:-1], edge[1:], strict=True)]
                        texts = [zstandard.ZstdCompressor(level=1).compress(x.as_py().encode()) for x in lists]
                        columns = [pa.array(own % blocks), langs.dictionary.take(pa.array(own // blocks)), pa.array(texts), pa.array(sizes)]
                        yield pa.RecordBatch.from_arrays(columns, names=["block", "lang", "phrases", "sizes"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts):
            return pa.concat_tables(parts).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])

        def full(parts):
            table = summed(parts)
            table = table.filter(pc.greater_equal(table["n"], least))
            k = pc.add(pc.count_substring(table["phrase"], " "), 1).cast(pa.int32())
            table = pa.table({"lang": table["lang"], "phrase": table["phrase"], "k": k, "f": table["n"]})
            yield from table.combine_chunks().to_batches()

        at, parts, size, limit = None, [], 0, 0
        for batch in batches:
            for row, block in enumerate(batch.column(0).to_pylist()):
                if block != at and parts:
                    yield from full(parts)
                    parts = []
                if not parts:
                    at, size, limit = block, 0, ADD_ROWS
                text = zstandard.ZstdDecompressor().decompress(batch.column(2)[row].as_py()).decode()
                phrases = pc.split_pattern(pa.array([text]), "\n").values
                lang = pa.array([batch.column(1)[row].as_py()]).take(pa.array(np.zeros(len(phrases), np.int32)))
                parts.append(pa.table({"lang": lang, "phrase": phrases, "n": unpacked(batch.column(3)[row], np.int64)}))
                size += len(phrases)
                if size >= limit:
                    parts = [summed(parts)]
                    size = parts[0].num_rows
                    limit = 2 * size + ADD_ROWS
        if parts:
            yield from full(parts)

    sent = shards.mapInArrow(send, "block long, lang string, phrases binary, sizes binary")
    met = sent.repartition("block").sortWithinPartitions("block")
    return met.mapInArrow(add, "lang string, phrase string, k int, f long")


def frequent_phrases(docs: DataFrame, lang: str, text: str, least: int) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, k, f`` of all phrases that occur ``least`` times, and ``lang, n``; both stored."""
    texts = _texts(docs, lang, text)
    counted = cut_lineage(word_counts(texts).filter((F.col("f") >= least) | F.col("word").isNull()), "collocation-words")
    totals = counted.filter("word IS NULL").select("lang", F.col("f").alias("n"))
    levels = [counted.filter("word IS NOT NULL").select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), "f")]
    filters = {1: frequent_filter(levels[0])}
    shards = make_shards(texts, filters[1])
    for shortest, longest in ((2, 2), (3, 3), (4, DEPTH)):
        likely = likely_pairs(shards, least) if longest == 2 else None
        found = phrase_counts(shards, dict(filters), shortest, longest, least, likely)
        levels.append(cut_lineage(found, "collocation-phrases"))
        if shortest == longest:
            filters[longest] = frequent_filter(levels[-1])
    frequent = levels[0]
    for level in levels[1:]:
        frequent = frequent.unionByName(level)
    return frequent, totals


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates that no longer one of the same count holds, with the cut that scores lowest."""
    words = F.split("phrase", " ")

    def part(start, size):
        return F.array_join(F.slice(words, start, size), " ")

    ends = F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))
    inner = frequent.filter("k > 2").select("lang", F.explode(ends).alias("phrase"), F.col("f").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = frequent.filter("k > 1").join(inner, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < f")
    cuts = kept.select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": part(F.lit(1), F.col("cut")), "right": part(F.col("cut") + 1, F.col("k") - F.col("cut"))})
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(frequent.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(totals, "lang").withColumns({"top": whole("a") * whole("n") * F.lit(1000).cast("decimal(4,0)"), "under": whole("l") * whole("r")})
    best = F.min(F.struct(F.expr("top div under").alias("score"), "cut", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by score."""
    rows = scored(*frequent_phrases(docs, lang, text, least))
    ranked = top_n(rows, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, folder):
    """Collocations of all documents."""
    return collocations(spark.read.parquet(f"{folder}/documents.parquet"))


SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
piece AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
split AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
size AS (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS k FROM split),
place AS (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM size WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS c FROM place GROUP BY ALL),
total AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, c, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND c >= 100),
shorter AS (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM cand WHERE k > 2),
inner_at AS (SELECT *, unnest(generate_series(1, k - m + 1)) AS i FROM shorter),
held AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(c) AS longer FROM inner_at GROUP BY ALL),
kept AS (SELECT cand.* FROM cand LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * c),
cut AS (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM kept),
parts AS (
  SELECT lang, phrase, c AS a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:k], ' ') AS rp FROM cut),
scored AS (
  SELECT parts.lang, parts.phrase, a, j, fl.c AS l, fr.c AS r, n,
         CAST((1000::HUGEINT * a * n) // (fl.c::HUGEINT * fr.c) AS BIGINT) AS score
  FROM parts JOIN total USING (lang) JOIN f fl ON fl.lang = parts.lang AND fl.phrase = lp
  JOIN f fr ON fr.lang = parts.lang AND fr.phrase = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000"""
