"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes ratios.

Presence of a character n-gram (``ORDERS`` bytes long, ASCII letters lowered, white
space as a blank) is a feature, hashed to ``2**BITS`` buckets. Each feature is scaled
by its naive Bayes log-count ratio between toxic and other labelled texts, the
``n_features`` most significant ratios are kept, and a logistic regression with a
square penalty is fitted on the scaled features.

It is fitted on a sample of at most ``max_per_class`` labelled texts of each class,
those with the smallest digests of their ids. Every text is scored, and whole.
Neither labels nor any column but the text enters a score.

Defined results:

* null or empty text, text shorter than an n-gram: no feature, the score of the
  intercept alone;
* null ``doc_id``: scored like any other and not held out;
* repeated rows get equal scores; a text labelled both ways counts once each way;
* no label of one class (also: empty tables): score 0.5 less a half, that is 0, for all;
* very long texts are read whole; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from kohorta.llm.frames import arrow_limits, map_texts, smallest_digests
from kohorta.llm.wordbytes import IS_SPACE, LOWER, text_blocks
from kohorta.session import cut_lineage

ORDERS, BITS, SMOOTHING, PENALTY = (3, 4, 5, 6), 18, 1.0, 1.0
BUCKETS = 1 << BITS
_FOLD = np.where(IS_SPACE, 32, LOWER).astype(np.uint8)
_LANES = np.random.default_rng(23).integers(0, 1 << 32, (max(ORDERS), 256), dtype=np.uint32)


def buckets(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(order, bucket of the n-gram at each place)`` for all orders."""
    folded = _FOLD[data]
    total = np.zeros(len(data), np.uint32)
    for k in range(max(ORDERS)):
        if len(data) <= k:
            return
        total = total[: len(data) - k] + _LANES[k][folded[k:]]
        if k + 1 in ORDERS:
            yield k + 1, (total * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def present(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray):
    """``(text, feature)`` pairs, each once: ``chosen`` maps buckets to features or -1."""
    docs, features = [], []
    for order, found in buckets(data):
        at = np.flatnonzero(chosen[found] >= 0)
        doc = np.searchsorted(offsets[1:], at, "right")
        inside = at + order <= offsets[doc + 1]
        docs.append(doc[inside])
        features.append(chosen[found[at[inside]]])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = int(chosen.max(initial=0)) + 1
    pairs = np.unique(np.concatenate(docs) * width + np.concatenate(features))
    return pairs // width, pairs % width


@dataclass
class Model:
    """``chosen``: feature of each bucket or -1; ``weights`` include the ratio scale."""

    chosen: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.intercept)
        for first, data, offsets in text_blocks(column):
            doc, feature = present(data, offsets, self.chosen)
            out[first : first + len(offsets) - 1] += np.bincount(
                doc, self.weights[feature], minlength=len(offsets) - 1
            )
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def held_out(doc_id: Column) -> Column:
    remainder = F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3
    return F.coalesce(remainder == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_per_class: int, seed: str) -> DataFrame:
    """``__text, __toxic`` of at most ``max_per_class`` labelled ids of each class.

    Ids first, by two top-n queries, so texts of other ids are read but not moved.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(
        ~held_out(F.col("doc_id"))
    )
    usable = usable.select(F.col("doc_id").alias("__key"), F.col("toxic").alias("__toxic")).distinct()
    key = F.concat_ws("|", F.lit(seed), F.col("__key").cast("string"))
    parts = [smallest_digests(usable.filter(F.col("__toxic") == k), key, max_per_class) for k in (0, 1)]
    ids = cut_lineage(parts[0].union(parts[1]), "toxicity-ids")
    arrow_limits(docs.sparkSession)
    texts = docs.select(F.col("doc_id").alias("__key"), F.col("text").alias("__text"))
    return cut_lineage(texts.join(ids.filter("__toxic >= 0"), "__key"), "toxicity-sample")


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that have a bucket, one row per bucket and task."""
    counts = np.zeros((2, BUCKETS), np.int64)
    every = np.arange(BUCKETS)
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for first, data, offsets in text_blocks(batch.column(0), 1):
            doc, bucket = present(data, offsets, every)
            for k in np.unique(doc):
                counts[toxic[first + k], bucket[doc == k]] += 1
    some = np.flatnonzero(counts.any(0))
    if len(some):
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], names=["b", "n0", "n1"]
        )


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Penalised logistic regression by Newton's method; the intercept is free."""
    x = np.c_[x, np.ones(len(x))]
    ridge = np.full(x.shape[1], PENALTY)
    ridge[-1] = 1e-9
    beta = np.zeros(x.shape[1])

    def loss(b):
        z = x @ b
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * b * b).sum()

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        gradient = x.T @ (p - y) + ridge * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step, scale, now = np.linalg.solve(hessian, gradient), 1.0, loss(beta)
        while loss(beta - scale * step) > now and scale > 1e-6:
            scale /= 2
        beta = beta - scale * step
        if np.abs(scale * step).max() < 1e-6:
            return beta[:-1], float(beta[-1])
    raise RuntimeError("the fit did not converge in 100 steps")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_per_class: int = 4_000,
    n_features: int = 512,
    seed: str = "toxicity-0",
) -> Model:
    """Model from the labelled texts that are not held out.

    Two jobs over the sample: counts per bucket (at most ``2**BITS`` rows reach the
    driver), then the chosen features of each sampled text.
    """
    sample = labelled_sample(docs, labels, max_per_class, seed)
    sizes = dict(map(tuple, sample.groupBy("__toxic").count().collect()))
    nothing = Model(np.full(BUCKETS, -1), np.zeros(1), -500.0)
    if not sizes.get(0) or not sizes.get(1):
        return nothing
    counted = sample.select("__text", F.col("__toxic").cast("int").alias("y")).mapInArrow(
        _count_buckets, "b long, n0 long, n1 long"
    )
    table = counted.groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    table = table.sort_values("b")
    n0, n1 = table["n0"].to_numpy(), table["n1"].to_numpy()
    share = lambda n, of: (n + SMOOTHING) / (of + 2 * SMOOTHING)
    ratio = np.log(share(n1, sizes[1])) - np.log(share(n0, sizes[0]))
    spread = np.sqrt(1 / (n0 + SMOOTHING) + 1 / (n1 + SMOOTHING))
    best = np.argsort(-np.abs(ratio / spread), kind="stable")[:n_features]
    chosen = np.full(BUCKETS, -1)
    chosen[table["b"].to_numpy()[best]] = np.arange(len(best))
    ratio = ratio[best]

    def features(column: pa.Array) -> list[pa.Array]:
        rows: list[list[int]] = [[] for _ in range(len(column))]
        for first, data, offsets in text_blocks(column):
            for d, f in zip(*present(data, offsets, chosen), strict=True):
                rows[first + d].append(int(f))
        return [pa.array(rows, pa.list_(pa.int32()))]

    found = map_texts(sample, "__text", ["__toxic"], StructType.fromDDL("f array<int>"), features)
    rows = sorted((int(r["__toxic"]), tuple(r["f"])) for r in found.collect())
    x = np.zeros((len(rows), len(best)))
    for i, (_, some) in enumerate(rows):
        x[i, list(some)] = ratio[list(some)]
    weights, intercept = _fit(x, np.array([y for y, _ in rows], float))
    return Model(chosen, weights * ratio, intercept)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, carry=("doc_id",), text: str = "text") -> DataFrame:
    """``carry`` columns with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def work(column: pa.Array) -> list[pa.Array]:
        scores = shared.value.scores(column)
        return [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]

    return map_texts(docs, text, list(carry), fields, work)


def query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
