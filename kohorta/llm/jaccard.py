"""N-gram Jaccard join: a blocked sparse product of the document by n-gram matrix.

Row: the distinct word n-grams of a text. Column: an n-gram. Two texts link when
``100 * overlap >= percent * union``. The product is never formed in full:

* equal rows are one class, and only classes are multiplied;
* by the size bound a link needs a shared n-gram among the first
  ``size - ceil(percent * size / 100) + 1`` of both rows in any fixed order of the
  n-grams. Only these columns, the blocks, are multiplied. The order is by estimated
  document count, rare n-grams first, so blocks are small;
* first pass: in each block every class meets one class of the block alone, that with the
  most frequent n-grams in its prefix, and of these partners it is verified against the
  one with the highest overlap. Copies of one text become one component here without a
  product of all their pairs;
* second pass: blocks that still hold several components are multiplied across
  components. The sizes of a pair set the overlap that its prefixes must have; an entry
  is multiplied only if so many entries can follow it in both rows, so pairs below the
  bound are never formed. The rest is verified.

Verification counts the whole overlap of both texts. What the first pass leaves out
lies inside one component, so no component is missed.

Document counts come from a sketch of fixed size over all texts, which is broadcast. It
decides the order, hence the speed, and never the result.

Defined results:

* null, empty or blank text: empty set, size 0, linked with nothing, a component of its own;
* fewer words than an n-gram: the whole sequence is the one n-gram;
* repeated rows: one result row each; equal sets are always linked;
* null ``doc_id``: takes part; ``component_id`` is the smallest id that is not null,
  and null if the component has none;
* empty table: empty result; very long texts are read whole;
* other columns play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from kohorta.llm import cells
from kohorta.llm.components import components
from kohorta.llm.frames import arrow_limits, map_texts, texts_of
from kohorta.llm.wordbytes import Block, mix, shingles, text_blocks
from kohorta.operators.skew import salted_join
from kohorta.session import cut_lineage

CELL_BITS = 24
#: Grams of at most a thousand documents or so are light.
LIGHT_LEVEL = 39


def gram_sets(column: pa.Array, size: int):
    """Yield ``(first row, texts, owner, gram)`` per block: distinct grams by text and hash."""
    for first, data, offsets in text_blocks(column):
        block = Block(data, offsets)
        doc, _, gram = shingles(block.word_hashes(lower=True), block.doc, size, short=True)
        order = np.lexsort((gram, doc))
        doc, gram = doc[order], gram[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
        yield first, block.n, doc[new], gram[new]


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def _leading(doc, gram, n, percent, rank) -> np.ndarray:
    """Places of the grams in the prefix of their text, in order of rank and hash."""
    order = np.lexsort((gram, rank, doc))
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return order[at < np.repeat(prefix_length(n, percent), n)]


def _level(counts: np.ndarray) -> np.ndarray:
    return (4 * np.log2(counts + 1.0)).astype(np.uint8)


def frequency_levels(docs: DataFrame, size: int, text: str) -> np.ndarray:
    """Logarithmic level of the document count of each cell of grams, ``2**CELL_BITS`` bytes.

    A count sketch of fixed size over all texts: a cell's count is at least the count of
    each of its grams.
    """

    def count(batches):
        counts = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            for _, _, _, gram in gram_sets(batch.column(0), size):
                np.add.at(counts, gram >> np.uint64(64 - CELL_BITS), 1)
        yield from cells.send_cells(counts)

    arrow_limits(docs.sparkSession)
    counted = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(count, cells.SCHEMA)
    return cells.add_cells(counted, 1 << CELL_BITS, np.uint8, _level)


def gram_rows(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """One row per document, written: id of the row, digests of the set, its prefix.

    The first ``light`` grams of a prefix are not frequent. ``hub`` is the sum of the levels
    of a prefix: among near copies, the text with the fewest changes has the highest.

    ``uid`` numbers rows by task and place; the table is written once, so a lost task
    cannot number them anew.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, size, text))
    place = [0]

    def work(column: pa.Array) -> list[pa.Array]:
        levels = shared.value
        rows = len(column)
        n, d1, d2 = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
        heads, (ends, light, hub) = [], np.zeros((3, rows), np.int64)
        for first, texts, doc, gram in gram_sets(column, size):
            span = slice(first, first + texts)
            n[span] = np.bincount(doc, minlength=texts)
            for out, turn in ((d1, 1), (d2, 2)):
                sums = np.zeros(len(gram) + 1, np.uint64)
                np.cumsum(mix(gram + np.uint64(turn)), dtype=np.uint64, out=sums[1:])
                edge = np.r_[0, np.cumsum(n[span])]
                out[span] = sums[edge[1:]] - sums[edge[:-1]]
            rank = levels[gram >> np.uint64(64 - CELL_BITS)]
            head = _leading(doc, gram, n[span], percent, rank)
            heads.append(gram[head])
            light[span] = np.bincount(doc[head][rank[head] <= LIGHT_LEVEL], minlength=texts)
            hub[span] = np.bincount(doc[head], rank[head], minlength=texts)
            ends[span] = prefix_length(n[span], percent)
        uid = (TaskContext.get().partitionId() << 40) + place[0] + np.arange(rows)
        place[0] += rows
        flat = np.concatenate(heads).view(np.int64) if heads else np.zeros(0, np.int64)
        prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(ends)], pa.int32()), pa.array(flat))
        return [pa.array(x) for x in (uid, n, d1.view(np.int64), d2.view(np.int64), light, hub)] + [prefix]

    source = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        F.xxhash64(F.col(text).cast("string")).alias("text_hash"),
    )
    fields = StructType.fromDDL("uid long, n long, d1 long, d2 long, light long, hub long, prefix array<long>")
    return cut_lineage(map_texts(source, "text", ["doc_id", "text_hash"], fields, work), "jaccard-rows")


def _overlaps(size: int, percent: int):
    """Keep the pairs ``(a, b)`` whose texts link, by their whole overlap."""

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            sets = []
            for side in (2, 3):
                parts = [None] * rows
                for first, texts, doc, gram in gram_sets(batch.column(side), size):
                    edge = np.searchsorted(doc, np.arange(texts + 1))
                    for k in range(texts):
                        parts[first + k] = gram[edge[k] : edge[k + 1]]
                sets.append(parts)
            keep = np.zeros(rows, bool)
            for i, (x, y) in enumerate(zip(*sets, strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            some = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(some), batch.column(1).filter(some)], names=["a", "b"]
            )

    return run


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int,
             doc_id: str, text: str) -> DataFrame:
    """Pairs of nodes that link; ``nodes`` has the id and text digest of each node.

    Texts of the nodes in question are fetched once; a pair then meets both of its
    texts by two joins that the adaptive skew join can split.
    """
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = cut_lineage(nodes.join(wanted, "node", "left_semi"), "jaccard-wanted")
    texts = texts_of(docs, wanted, "node", doc_id, text).select("node", "text")
    texts = cut_lineage(texts, "jaccard-texts")
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    arrow_limits(docs.sparkSession)
    return cut_lineage(met.mapInArrow(_overlaps(size, percent), "a long, b long"), "jaccard-links")


def _entries(classes: DataFrame, part) -> DataFrame:
    return classes.select("node", "hub", "light", F.posexplode(part).alias("place", "gram"))


def _blocks(classes: DataFrame) -> DataFrame:
    """``gram, node, place, lead, hot`` of all blocks with two classes or more.

    ``lead`` has the top hub, ``place`` is that of the gram in the prefix of the node.

    Entries of grams that are not frequent lie in small groups: one exchange, then a
    window. Frequent grams are counted with map-side combine and joined by salt.
    """
    small = Window.partitionBy("gram")
    top = F.max(F.struct("hub", "node"))
    light = (
        _entries(classes, F.slice("prefix", F.lit(1), F.col("light").cast("int")))
        .withColumn("first", F.min("node").over(small))
        .withColumn("last", F.max("node").over(small))
        .filter("first < last")
        .select("gram", "node", "place", top.over(small)["node"].alias("lead"), F.lit(False).alias("hot"))
    )
    rest = F.slice("prefix", (F.col("light") + 1).cast("int"), F.size("prefix"))
    frequent = _entries(classes, rest).withColumn("place", (F.col("place") + F.col("light")).cast("int"))
    leads = frequent.groupBy("gram").agg(
        top["node"].alias("lead"), F.min("node").alias("first"), F.max("node").alias("last")
    )
    hot = salted_join(frequent, leads.filter("first < last").select("gram", "lead"), "gram")
    return light.union(hot.select("gram", "node", "place", "lead", F.lit(True).alias("hot")))


def _open_blocks(placed: DataFrame) -> DataFrame:
    """Rows of the blocks that hold more than one component."""
    small = Window.partitionBy("gram")
    light = (
        placed.filter("NOT hot")
        .withColumn("lo", F.min("comp").over(small))
        .withColumn("hi", F.max("comp").over(small))
        .filter("lo < hi")
        .select("gram", "node", "n", "at", "held", "comp")
    )
    hot = placed.filter("hot").select("gram", "node", "n", "at", "held", "comp")
    ends = hot.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return light.union(salted_join(hot, ends.filter("lo < hi").select("gram"), "gram"))


def _sizes_allow(percent: int):
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def link_components(
    docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` and ``text_hash, component`` for each row of ``docs``.

    ``component`` is null for a text without words.
    """
    rows = gram_rows(docs, size, percent, doc_id, text)
    filled = rows.filter("n > 0")
    one = F.struct("uid", "doc_id", "text_hash", "light", "hub", "prefix")
    classes = filled.groupBy("d1", "d2", "n").agg(F.min(one).alias("first"), F.min("doc_id").alias("least"))
    classes = cut_lineage(
        classes.select("d1", "d2", "n", "least", F.col("first.uid").alias("node"), "first.*").drop("uid"),
        "jaccard-classes",
    )
    nodes = classes.select("node", "doc_id", "text_hash")
    blocks = cut_lineage(_blocks(classes.select("node", "light", "hub", "prefix")), "jaccard-blocks")

    stars = blocks.filter("node != lead").groupBy("node", "lead").agg(F.count("*").alias("c"))
    na = classes.select("node", F.col("n").alias("n_a"))
    nb = classes.select(F.col("node").alias("lead"), F.col("n").alias("n_b"))
    best = (
        stars.join(na, "node")
        .join(nb, "lead")
        .filter(_sizes_allow(percent))
        .groupBy(F.col("node").alias("a"))
        .agg(F.max(F.struct("c", "lead")).alias("best"))
        .select("a", F.col("best.lead").alias("b"))
    )
    best = cut_lineage(best, "jaccard-first")
    links = verified(best, nodes, docs, size, percent, doc_id, text)
    labels = components(links)

    labelled = labels.withColumnRenamed("comp", "label")
    sized = classes.select("node", "n").join(labelled, "node", "left")
    sized = sized.select("node", "n", F.coalesce("label", "node").alias("comp"))
    own = Window.partitionBy("node")
    ranked = blocks.select(
        "gram", "hot", "node", F.row_number().over(own.orderBy("place")).alias("at"), F.count("*").over(own).alias("held")
    )
    placed = cut_lineage(ranked.join(sized, "node"), "jaccard-placed")
    live = cut_lineage(_open_blocks(placed), "jaccard-live")
    side = lambda x: live.select("gram", *[F.col(c).alias(c + x) for c in ("node", "n", "at", "held", "comp")])
    # So many grams of both prefixes must be common: what a link needs less what lies behind them.
    overlap = F.ceil((F.col("n_a") + F.col("n_b")) * percent / F.lit(100.0 + percent) - 1e-6)
    least = F.greatest(overlap - F.ceil(F.greatest("n_a", "n_b") * percent / 100.0 - 1e-6) + 1, F.lit(1))
    # The first common gram has all others behind it, so it cannot stand late in either.
    early = [F.col(f"at_{x}") <= F.col(f"held_{x}") - least + 1 for x in "ab"]
    crossing = (
        side("_a")
        .join(side("_b"), "gram")
        .filter((F.col("comp_a") < F.col("comp_b")) & _sizes_allow(percent) & early[0] & early[1])
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        .distinct()
    )
    tested = best.select("a", "b").union(best.select(F.col("b").alias("a"), F.col("a").alias("b")))
    crossing = cut_lineage(crossing.join(tested, ["a", "b"], "left_anti").select("a", "b"), "jaccard-second")
    more = verified(crossing, nodes, docs, size, percent, doc_id, text)
    labels = components(links.union(more))

    classed = salted_join(classes, labels, "node", "left").withColumn("component", F.coalesce("comp", "node"))
    smallest = classed.groupBy("component").agg(F.min("least").alias("component_id"))
    classed = cut_lineage(salted_join(classed, smallest, "component"), "jaccard-classed")
    joined = rows.select("doc_id", "text_hash", "n", "d1", "d2").join(
        classed.select("d1", "d2", "n", "component", "component_id"), ["d1", "d2", "n"], "left"
    )
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "text_hash",
        "component",
    )


def query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return link_components(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """Rows of ``docs``, one of each component: smallest id, then smallest text digest.

    Texts without words stay, all of them. Null ids come last.
    """
    found = link_components(docs, size, percent, doc_id, text)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    chosen = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("m"))
    chosen = cut_lineage(chosen.select("component", "m.doc_id", "m.text_hash"), "jaccard-kept")
    kept = texts_of(docs, chosen, "component", doc_id, text, whole_rows=True).select("row.*")
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return kept.union(docs.filter(~whole.rlike(r"[^\x20\x09-\x0D]")))
