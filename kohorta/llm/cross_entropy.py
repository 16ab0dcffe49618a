"""Language-model scoring by cross-entropy difference.

Two bigram models with one vocabulary, one of a target set of texts and one of the
background corpus, give each token a loss. The mean over the tokens of a text of
(background loss - target loss) is its score: the higher, the more it reads like the
target (Moore and Lewis, 2010).

Tokens are lower-case (A-Z) words, named by 64-bit hashes. A token's probability
interpolates its pair and its own frequency:

    p(w | v) = (pair(v, w) + MASS * p(w)) / (context(v) + MASS)
    p(w) = (count(w) + 1) / (tokens + vocabulary)

with ``context(v)`` the count of ``v`` as first of a pair and ``vocabulary`` the number of
background words and one unknown; a text begins with a mark. Counts cover all texts of the
table, whole, and are exact: every word and every pair is counted, so what is gathered
grows with the corpus. No row is made for a pair:

* each task packs its texts into blocks of about ``BLOCK_TOKENS`` tokens, which are stored:
  the block's words, and each token as a number among them, the most frequent first;
* ids of the targets are looked up by narrow rows (id, block, place), so no text travels;
* a block sends its different pairs and words, sorted, as packed lists of hashes and counts,
  one list for each of the cells that the hash space is cut into;
* the lists, with the counts of both models, of a cell meet in one task and are added up, and each list gets its totals back
  in its own order, so a pair that stands once in the corpus costs a few bytes on the way
  and next to none on the way back;
* a stored block and its totals meet again and give the losses of its texts.

Cells grow in number with the tokens and hold about ``CELL_TOKENS`` of them, blocks grow in
number only. A block names each pair once, so a frequent pair is no hot key.

Defined results:

* null or empty text: no tokens, losses and score 0;
* null ``doc_id``, or one that the targets' type cannot hold: scored like any other, no target; repeated rows get equal scores, and count as
  often as they stand in the table;
* no target text: the target model is uniform over the vocabulary;
* empty table: empty result;
* very long texts are read whole, each a block of its own; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kohorta.llm.frames import arrow_limits
from kohorta.llm.wordbytes import Block, mix, text_blocks
from kohorta.operators.skew import salted_join
from kohorta.session import LARGE_ROWS, cut_lineage

MASS = 50.0
START = np.uint64(0x5374617274)
BLOCK_TOKENS, CELL_TOKENS, LEAST_CELLS = 1 << 20, 1 << 21, 64

BLOCK = "block long, n long, words binary, tokens binary, sizes binary, carried binary"
COUNTS = ["nb", "nt", "ob", "ot", "cb", "ct"]
LIST = "block long, cell long, pairs binary, words binary, " + ", ".join(f"{c} binary" for c in COUNTS)
TOTAL = "block long, cell long, " + ", ".join(f"{c} binary" for c in COUNTS) + ", vocabulary long, all_b long, all_t long"


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes; planes of small numbers are mostly zero."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(packed: pa.Scalar) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed.as_py()), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(packed: pa.Scalar) -> np.ndarray:
    return np.cumsum(_unpack(packed), dtype=np.uint64)


def _carried(packed: pa.Scalar) -> pa.Table:
    with pa.ipc.open_stream(packed.as_py()) as stream:
        return stream.read_all()


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(f.split(" ") for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def word_blocks(texts: DataFrame, carry: list[str], block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Texts ``t`` packed into blocks: hashes of the words, number of each token's word, tokens of each text.

    ``carry`` columns come along, in the order of the texts.
    """

    def packed(held, number) -> pa.RecordBatch:
        hashes = np.concatenate([h for h, _, _ in held])
        words, tokens, n = np.unique(np.append(hashes, START), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0][2].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for _, _, rows in held:
                out.write_batch(rows)
        sizes = np.concatenate([s for _, s, _ in held])
        block = (TaskContext.get().partitionId() << 33) + number
        row = (block, len(hashes), _pack(words[order]), _pack(rank[tokens[:-1]]), _pack(sizes), sink.getvalue().to_pybytes())
        return _batch(BLOCK, [row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for batch in batches:
            rows = batch.select(batch.schema.names[1:])
            for first, data, offsets in text_blocks(batch.column(0)):
                block = Block(data, offsets)
                held.append((block.word_hashes(lower=True), block.count(block.doc), rows.slice(first, block.n)))
                size += len(block.starts) + block.n
                if size >= block_tokens:
                    yield packed(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield packed(held, number)

    arrow_limits(texts.sparkSession)
    return texts.select(F.col("t").cast("string"), *carry).mapInArrow(run, BLOCK)


def target_places(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """``block, places``: where in each block the texts of ``targets(doc_id)`` stand; stored.

    The first carried column is the id.
    """
    kind = targets.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, carried in zip(*batch.columns, strict=True):
                ids = _carried(carried).column(0).combine_chunks()
                columns = [pa.array(np.full(len(ids), block.as_py())), pa.array(np.arange(len(ids))), ids]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "place", "id"])

    ids = blocks.select("block", "carried").mapInArrow(run, f"block long, place long, id {kind}").dropna()
    wanted = targets.select(F.col("doc_id").alias("id")).dropna().distinct()
    # As many as a share of the texts, and in files a fraction of the size that they have in memory.
    found = salted_join(ids, wanted, "id", "inner", broadcast=False).groupBy("block").agg(F.collect_list("place").alias("places"))
    return cut_lineage(found, "cross-entropy-targets")


class Texts:
    """Words, tokens and pairs of one stored block; ``before`` and ``now`` are numbers of sorted words."""

    def __init__(self, words: pa.Scalar, tokens: pa.Scalar, sizes: pa.Scalar):
        ranked = _unpack(words)
        order = np.argsort(ranked)
        at = np.empty_like(order)
        at[order] = np.arange(len(order))
        self.words, self.sizes = ranked[order], _unpack(sizes).astype(np.int64)
        self.now = at[_unpack(tokens).astype(np.int64)]
        self.before = np.empty_like(self.now)
        self.before[1:] = self.now[:-1]
        self.before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = np.searchsorted(self.words, START)
        self.pairs = mix(mix(self.words[self.before]) + self.words[self.now])


def _cells_of(keys: np.ndarray, cells: int) -> np.ndarray:
    """Where the sorted ``keys`` of each cell begin; cells are equal ranges of the highest 32 bits."""
    cell = ((keys >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
    return np.searchsorted(cell, np.arange(cells + 1, dtype=np.uint64))


def cell_lists(blocks: DataFrame, cells: int) -> DataFrame:
    """A block's different pairs and words with their counts in all texts and in targets, cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, places, *packed in zip(*batch.columns, strict=True):
                texts = Texts(*packed)
                target = np.zeros(len(texts.sizes), bool)
                target[places.as_py() or []] = True
                target = np.repeat(target, texts.sizes)
                pairs, pair = np.unique(texts.pairs, return_inverse=True)
                counts = [
                    np.bincount(x[some], minlength=size)
                    for x, size in ((pair, len(pairs)), (texts.now, len(texts.words)), (texts.before, len(texts.words)))
                    for some in (slice(None), target)
                ]
                at, to = _cells_of(pairs, cells), _cells_of(texts.words, cells)
                rows = []
                for cell in np.flatnonzero((np.diff(at) > 0) | (np.diff(to) > 0)).tolist():
                    p, w = slice(at[cell], at[cell + 1]), slice(to[cell], to[cell + 1])
                    lists = [_pack(x[of]) for x, of in zip(counts, (p, p, w, w, w, w), strict=True)]
                    rows.append((block.as_py(), cell, _pack_sorted(pairs[p]), _pack_sorted(texts.words[w]), *lists))
                    if len(rows) == 256:
                        yield _batch(LIST, rows)
                        rows = []
                if rows:
                    yield _batch(LIST, rows)

    return blocks.select("block", "places", "words", "tokens", "sizes").mapInArrow(run, LIST)


def _add_up(table: pa.Table) -> pa.Table:
    """Totals of one cell in the order of each list; corpus sums stand in its first row."""

    def totals(keys: str, counts: list[str]):
        lists = [_unpack_sorted(x) for x in table[keys]]
        edge = np.cumsum([0, *map(len, lists)])
        found, place = np.unique(np.concatenate(lists), return_inverse=True)
        sums = [np.bincount(place, np.concatenate([_unpack(x) for x in table[c]]), len(found)) for c in counts]
        return edge, place, sums

    pair_edge, pair, pair_sums = totals("pairs", COUNTS[:2])
    word_edge, word, word_sums = totals("words", COUNTS[2:])
    ob, ot = word_sums[:2]
    rows = []
    for i in range(table.num_rows):
        p, w = pair[pair_edge[i] : pair_edge[i + 1]], word[word_edge[i] : word_edge[i + 1]]
        packed = [_pack(x[p]) for x in pair_sums] + [_pack(x[w]) for x in word_sums]
        sums = (0, 0, 0) if i else ((ob > 0).sum(), ob.sum(), ot.sum())
        rows.append((table["block"][i].as_py(), table["cell"][i].as_py(), *packed, *map(int, sums)))
    return pa.Table.from_batches([_batch(TOTAL, rows)])


def exact_scores(
    docs: DataFrame, targets: DataFrame, text: str = "text", doc_id: str = "doc_id", carry=("doc_id",),
    block_tokens: int = BLOCK_TOKENS, cell_tokens: int = CELL_TOKENS, least_cells: int = LEAST_CELLS,
) -> DataFrame:
    """``score`` of all rows of ``docs`` by exact counts of ``docs`` and of its ``targets(doc_id)``."""
    names = [f"c{i}" for i in range(len(carry))]
    kind = targets.schema["doc_id"].dataType
    own = [F.col(f"`{c}`").alias(name) for c, name in zip(carry, names, strict=True)]
    rows = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{doc_id}`").try_cast(kind).alias("id"), *own)
    blocks = cut_lineage(word_blocks(rows, ["id", *names], block_tokens), "cross-entropy-blocks", **LARGE_ROWS)
    tokens = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cells = max(least_cells, -(-tokens // cell_tokens))
    lists = cell_lists(blocks.join(target_places(blocks, targets), "block", "left"), cells)
    totals = cut_lineage(lists.groupBy("cell").applyInArrow(_add_up, TOTAL), "cross-entropy-totals", **LARGE_ROWS)
    corpus = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("vocabulary", "all_b", "all_t")]).first()
    vocabulary, all_b, all_t = map(int, corpus)

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("cell")

        def of(name: str) -> np.ndarray:
            parts = [_unpack(x) for x in found[name]]
            return np.concatenate([np.zeros(0, np.uint64), *parts]).astype(np.float64)

        texts = Texts(*(own[c][0] for c in ("words", "tokens", "sizes")))
        pair = np.unique(texts.pairs, return_inverse=True)[1]
        doc = np.repeat(np.arange(len(texts.sizes)), texts.sizes)
        losses = []
        for n, o, c, size in (("nt", "ot", "ct", all_t), ("nb", "ob", "cb", all_b)):
            p = MASS * (of(o) + 1) / (size + vocabulary + 1)
            loss = np.log(of(c) + MASS)[texts.before] - np.log(of(n)[pair] + p[texts.now])
            losses.append(np.bincount(doc, loss, minlength=len(texts.sizes)) / np.maximum(texts.sizes, 1))
        target, background = losses
        made = _carried(own["carried"][0]).drop_columns(["id"])
        values = (texts.sizes, target, background, background - target)
        for name, value in zip(("n_tokens", "target_loss", "background_loss", "score"), values, strict=True):
            made = made.append_column(name, pa.array(value))
        return made

    kept = StructType([rows.schema[name] for name in names])
    made = StructType.fromDDL("n_tokens long, target_loss double, background_loss double, score double")
    scored = blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, StructType(kept.fields + made.fields))
    return scored.select(*[F.col(name).alias(c) for c, name in zip(carry, names, strict=True)], *made.names)


def query(spark, folder):
    """Documents scored against those that are labelled good, to six digits."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1")
    scored = exact_scores(docs, good)
    # Zero is added so that no rounded value is a negative zero.
    return scored.withColumns({c: F.round(c, 6) + 0.0 for c in ("target_loss", "background_loss", "score")})


SQL = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) IS TRUE AS good,
         list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
token AS (
  SELECT r, good, unnest(words) AS w, unnest(list_concat([' '], words[1:len(words) - 1])) AS v
  FROM texts WHERE len(words) > 0),
pair AS (SELECT v, w, count(*) AS nb, count(*) FILTER (good) AS nt FROM token GROUP BY v, w),
own AS (SELECT w, sum(nb) AS ob, sum(nt) AS ot FROM pair GROUP BY w),
context AS (SELECT v, sum(nb) AS cb, sum(nt) AS ct FROM pair GROUP BY v),
total AS (SELECT count(*) AS vocabulary, sum(ob) AS all_b, sum(ot) AS all_t FROM own),
loss AS (
  SELECT v, w,
         ln(ct + 50.0::DOUBLE) - ln(nt + 50.0::DOUBLE * (ot + 1) / (all_t + vocabulary + 1)) AS lt,
         ln(cb + 50.0::DOUBLE) - ln(nb + 50.0::DOUBLE * (ob + 1) / (all_b + vocabulary + 1)) AS lb
  FROM pair JOIN own USING (w) JOIN context USING (v) CROSS JOIN total),
summed AS (SELECT r, avg(lt) AS lt, avg(lb) AS lb FROM token JOIN loss USING (v, w) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_tokens, round(coalesce(lt, 0), 6) + 0.0::DOUBLE AS target_loss,
       round(coalesce(lb, 0), 6) + 0.0::DOUBLE AS background_loss, round(coalesce(lb - lt, 0), 6) + 0.0::DOUBLE AS score
FROM texts LEFT JOIN summed USING (r)"""
