"""Quality rules judged by isolation forests.

Each text gets rule statistics (words, symbols, repeated lines, repeated 8-word
windows). Two base rules fail a text outright. The others are judged by isolation
forests: random splits, one forest for each view of the statistics. A text whose
path is short is anomalous, and each forest has its own threshold, calibrated on
the labelled good texts so that at most ``false_rejects`` of them lie above it.

Every labelled text takes part: each tree splits its own draw of ``sample`` rows, as
isolation forests are defined, and draws from all of them; thresholds are exact
quantiles over all labelled good texts. Whole texts are read throughout.

Defined results:

* null or empty text: no words, so ``base_failed`` and not kept;
* null ``doc_id``: judged like any other text;
* repeated rows are judged one by one, with equal results;
* no labelled text (also: all labels null): nothing but the base rules rejects;
* a text labelled both ways counts once each way;
* very long texts are read whole, as a block of their own;
* an empty table gives an empty table; other columns are carried if asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from kohorta.llm.frames import map_texts
from kohorta.llm.wordbytes import Block, mix, shingles, text_blocks
from kohorta.session import cut_lineage

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rule statistics of a view, by position in ``features``.
VIEWS = ((0,), (1,), (2,), (3,), (0, 1, 2, 3))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def block_statistics(block: Block) -> np.ndarray:
    """One row of ``STATISTICS`` for each text of a block."""
    data, n = block.data, block.n
    words = block.word_hashes()
    n_words = block.count(block.doc)
    word_chars = block.per_doc(block.word_byte & ((data & 0xC0) != 0x80))
    symbols = block.per_doc(_SYMBOL[data])

    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.r_[block.offsets[:-1], breaks + 1])
    owner = np.searchsorted(block.offsets[1:], starts, "right")
    inside = owner < n
    starts, owner = starts[inside], owner[inside]
    ends = np.minimum(np.r_[starts[1:], len(data)], block.offsets[owner + 1])
    at_break = np.zeros(len(data) + 1, bool)
    at_break[breaks] = True
    ends = np.where((ends > starts) & at_break[np.maximum(ends - 1, 0)], ends - 1, ends)
    filled = np.searchsorted(block.starts, ends) > np.searchsorted(block.starts, starts)
    starts, ends, owner = starts[filled], ends[filled], owner[filled]
    lines = block.span_hashes(starts, ends, block.prefix_sums())
    order = np.lexsort((lines, owner))
    same = (lines[order][1:] == lines[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    dup_lines = block.count(owner[order][1:][same])

    doc, at, window = shingles(words, block.doc, WINDOW)
    key = mix(window ^ mix(doc.astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    found = np.zeros(len(key), bool)
    found[1:] |= same
    found[:-1] |= same
    at = at[order[found]]
    edge = np.bincount(at, minlength=len(words) + WINDOW + 1).astype(np.int64)
    edge[WINDOW:] -= edge[:-WINDOW].copy()
    repeated = block.count(block.doc[np.cumsum(edge)[: len(words)] > 0])
    return np.c_[n_words, word_chars, symbols, dup_lines, repeated, block.count(owner)]


def statistics(column: pa.Array) -> np.ndarray:
    parts = [block_statistics(Block(data, offsets)) for _, data, offsets in text_blocks(column)]
    return np.vstack(parts) if parts else np.zeros((0, len(STATISTICS)), np.int64)


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])


def features(stats: np.ndarray) -> np.ndarray:
    """Symbols, repeated words and characters per word; repeated lines per line."""
    words, lines = np.maximum(stats[:, 0], 1), np.maximum(stats[:, 5], 1)
    return np.c_[stats[:, 2] / words, stats[:, 4] / words, stats[:, 1] / words, stats[:, 3] / lines]


def mean_path(n: int) -> float:
    """Mean path of a failed search among ``n`` keys; the usual scale of path lengths."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays of nodes; ``column`` is -1 at a leaf, ``depth`` its path length."""

    view: tuple[int, ...]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    scale: float
    threshold: float = math.inf

    @classmethod
    def grow(cls, rows: np.ndarray, view, n_trees: int, sample: int, seed: int) -> Forest:
        """Trees over draws from ``rows``."""
        rng = np.random.default_rng([seed, *view])
        size = min(sample, len(rows))
        return cls.of_draws((rows[rng.choice(len(rows), size, replace=False)] for _ in range(n_trees)), size, view, rng)

    @classmethod
    def of_draws(cls, draws: Iterable[np.ndarray], size: int, view, rng: np.random.Generator) -> Forest:
        """One tree for each draw of ``size`` rows; fewer than two rows give no tree."""
        most = math.ceil(math.log2(max(size, 2)))
        trees = []
        for draw in draws if size > 1 else ():
            column, split, left, depth = [], [], [], []
            todo = [(draw[:, view], 0)]
            place = 0
            column.append(-1), split.append(0.0), left.append(0), depth.append(0.0)
            slots = [0]
            while place < len(todo):
                part, level = todo[place]
                at = slots[place]
                place += 1
                low, high = part.min(0), part.max(0)
                wide = np.flatnonzero(high > low)
                if level >= most or len(part) < 2 or not len(wide):
                    depth[at] = level + mean_path(len(part))
                    continue
                j = int(rng.choice(wide))
                cut = rng.uniform(low[j], high[j])
                below = part[:, j] <= cut
                column[at], split[at], left[at] = j, cut, len(column)
                for child in (part[below], part[~below]):
                    slots.append(len(column))
                    todo.append((child, level + 1))
                    column.append(-1), split.append(0.0), left.append(0), depth.append(0.0)
            trees.append(tuple(np.array(x) for x in (column, split, left, depth)))
        return cls(tuple(view), trees, max(mean_path(size), 1e-9))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1]: higher for shorter mean paths."""
        if not self.trees:
            return np.zeros(len(rows))
        rows = rows[:, self.view]
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for column, split, left, depth in self.trees:
            node = np.zeros(len(rows), np.int64)
            inner = every[column[node] >= 0]
            while len(inner):
                n = node[inner]
                node[inner] = left[n] + (rows[inner, column[n]] > split[n])
                inner = inner[column[node[inner]] >= 0]
            total += depth[node]
        return 2.0 ** (-total / len(self.trees) / self.scale)

    def calibrate(self, good: np.ndarray, false_rejects: float) -> Forest:
        """Lowest threshold that at most this share of the good rows exceeds."""
        if len(good) and self.trees:
            scores = np.sort(self.scores(good))
            self.threshold = float(scores[len(scores) - 1 - int(false_rejects * len(scores))])
        return self


def labelled_statistics(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics of every labelled text with its label and how often it stands there, written.

    Statistics, not texts, meet the labels, so no text is shuffled.
    """
    usable = (
        labels.filter("quality >= 0 AND doc_id IS NOT NULL")
        .select(F.col("doc_id").alias("__key"), F.col("quality").alias("__quality"))
        .distinct()
    )
    texts = docs.select(F.col(doc_id).alias("__key"), F.col(text).alias("__text"))
    fields = StructType([StructField(n, LongType()) for n in STATISTICS])
    found = map_texts(texts, "__text", ["__key"], fields, lambda c: list(map(pa.array, statistics(c).T)))
    rows = found.join(usable, "__key").groupBy("__key", "__quality", *STATISTICS)
    return cut_lineage(rows.agg(F.count("*").alias("__copies")), "quality-labelled")


def _table(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the rows that pass the base rules, and two more columns of these."""
    stats = np.column_stack([batch.column(i).to_numpy() for i in range(len(STATISTICS))])
    passed = ~base_failed(stats)
    return features(stats)[passed], *(batch.column(len(STATISTICS) + i).to_numpy()[passed] for i in (0, 1))


def tree_draws(rows: DataFrame, n_trees: int, sample: int, seed: int) -> list[np.ndarray]:
    """For each tree, features of ``sample`` rows drawn from all that pass the base rules.

    A row has a number for each tree, and the smallest are drawn. A task hands over
    ``sample`` rows a tree at most, and as many reach the driver.
    """
    every = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    number = F.xxhash64(F.lit(seed), F.col("__key").cast("string"), "__quality", *STATISTICS, "__copy")

    def smallest(numbers, found):
        if len(numbers) <= sample:
            return numbers, found
        best = np.argpartition(numbers, sample - 1)[:sample]
        return numbers[best], found[best]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix(np.arange(1, n_trees + 1, dtype=np.uint64))
        held = [(np.zeros(0, np.int64), np.zeros((0, 4))) for _ in range(n_trees)]
        for batch in batches:
            found, number, _ = _table(batch)
            for t, salt in enumerate(salts):
                own = (mix(number.view(np.uint64) ^ salt) >> np.uint64(1)).view(np.int64)
                if len(held[t][0]) == sample:
                    near = own < held[t][0].max()
                    if not near.any():
                        continue
                    own, rest = own[near], found[near]
                else:
                    rest = found
                held[t] = smallest(np.r_[held[t][0], own], np.r_[held[t][1], rest])
        for t, (numbers, found) in enumerate(held):
            columns = [np.full(len(numbers), t), numbers, *found.T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tree", "number", *"abcd"])

    numbered = every.select(*STATISTICS, number.alias("__number"), "__copy")
    near = numbered.mapInArrow(draw, "tree long, number long, a double, b double, c double, d double")
    order = Window.partitionBy("tree").orderBy("number", *"abcd")
    drawn = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample).toPandas()
    drawn = drawn.sort_values(["tree", "rank"])
    return [drawn.loc[drawn.tree == t, list("abcd")].to_numpy() for t in range(n_trees)]


def at_rank(rows: DataFrame, rank: int, forests: int) -> list[int]:
    """``bits`` at a rank, from 0, among the ``rows(forest, bits, copies)`` of each forest.

    Exact for any number of rows: sixteen bits are settled in each of four passes, of
    which counts reach the driver.
    """
    left, head = [rank] * forests, [0] * forests
    for shift in (48, 32, 16, 0):
        part = rows
        if shift < 48:
            known = [(F.col("forest") == f) & (F.shiftright("bits", shift + 16) == head[f]) for f in range(forests)]
            part = rows.filter(reduce(or_, known))
        counts = part.groupBy("forest", F.shiftright("bits", shift).alias("head")).agg(F.sum("copies").alias("n")).collect()
        for f in range(forests):
            for at, n in sorted((r.head, r.n) for r in counts if r.forest == f):
                if left[f] < n:
                    head[f] = at
                    break
                left[f] -= n
    return head


def calibrate_all(rows: DataFrame, forests: list[Forest], false_rejects: float) -> list[Forest]:
    """Lowest thresholds that at most this share of all good rows exceeds."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, copies, _ = _table(batch)
            for k, forest in enumerate(forests):
                bits = forest.scores(found).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(bits), k)), pa.array(bits), pa.array(copies)], names=["forest", "bits", "copies"]
                )

    good = rows.filter("__quality = 1").select(*STATISTICS, "__copies", F.col("__copies").alias("__again"))
    scored = cut_lineage(good.mapInArrow(score, "forest long, bits long, copies long"), "quality-scores")
    n = scored.filter("forest = 0").agg(F.sum("copies")).first()[0]
    if n and forests[0].trees:
        for forest, bits in zip(forests, at_rank(scored, n - 1 - int(false_rejects * n), len(forests)), strict=True):
            forest.threshold = float(np.int64(bits).view(np.float64))
    return forests


def fit_forests(
    docs: DataFrame,
    labels: DataFrame,
    n_trees: int = 64,
    sample: int = 256,
    false_rejects: float = 0.0005,
    seed: int = 17,
    doc_id: str = "doc_id",
    text: str = "text",
) -> list[Forest]:
    """Grown and calibrated forests, one per view, from all labelled texts.

    The draws of the trees, a few numbers a row, and counts are all that reaches the
    driver. A repeated document counts as often as it stands in ``docs``.
    """
    rows = labelled_statistics(docs, labels, doc_id, text)
    draws = tree_draws(rows, n_trees, sample, seed)
    forests = [Forest.of_draws(draws, len(draws[0]), view, np.random.default_rng([seed, *view])) for view in VIEWS]
    return calibrate_all(rows, forests, false_rejects)


def judge(docs: DataFrame, forests: list[Forest], text: str = "text", carry=("doc_id",)) -> DataFrame:
    """``carry`` columns, the rule statistics, ``base_failed``, ``kept`` and ``anomaly``.

    ``anomaly`` is the largest score less its threshold: above 0, the text goes.
    """
    shown = STATISTICS[:-1]
    fields = StructType(
        [StructField(n, LongType()) for n in shown]
        + [StructField("base_failed", BooleanType()), StructField("kept", BooleanType())]
        + [StructField("anomaly", DoubleType())]
    )

    def work(column: pa.Array) -> list[pa.Array]:
        stats = statistics(column)
        failed, rows = base_failed(stats), features(stats)
        over = np.full(len(stats), -1.0)
        for forest in forests:
            if math.isfinite(forest.threshold):
                over = np.maximum(over, forest.scores(rows) - forest.threshold)
        kept = ~failed & (over <= 0)
        return [pa.array(stats[:, i]) for i in range(len(shown))] + [
            pa.array(failed), pa.array(kept), pa.array(over)
        ]

    return map_texts(docs, text, list(carry), fields, work)


def query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return judge(docs, fit_forests(docs, labels))


def keep_good(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep, with the columns of ``docs``."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    names = [f"c{i}" for i in range(len(docs.columns))]
    numbered = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    forests = fit_forests(docs, labels)
    return judge(numbered, forests, text, names).filter("kept").select(*names).toDF(*docs.columns)
