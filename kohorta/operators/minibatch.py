"""Training by mini-batches, and choice among candidates on the validation part.

``train`` fits a logistic model on hashed words by AdamW: batches in a seeded order that is
new in each epoch, a rate that rises over the warm-up steps and then falls to zero, and
decay of the weights apart from the gradient. Rows are dealt out by a digest of their key to
shards of about ``shard_rows`` rows; each shard goes through its batches one after another
from the weights at the start of the epoch, and the weights of all shards, with their moment
estimates, are averaged by rows. One shard is plain mini-batch training. An epoch is one job:
Spark sorts the rows by shard and order, and a task streams them, holding a model and a
mini-batch, never a shard. What reaches the driver is a model, whose size is fixed.

The outcome depends on keys, texts, labels and the rule alone, not on how rows are stored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kohorta.operators.classify import binary_cells, metrics_of, with_normal_text
from kohorta.session import cut_lineage

BLOCK = 4096


@dataclass(frozen=True)
class Rule:
    epochs: int = 10
    batch: int = 64
    rate: float = 0.01
    warmup: int = 500
    decay: float = 0.01
    seed: int = 42
    features: int = 1 << 16
    shard_rows: int = 50_000


@dataclass
class Trained:
    """Weights after each epoch (the last entry is the bias) and the loss on the way there."""

    rule: Rule
    idf: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)
    loss: list[float] = field(default_factory=list)

    def losses(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(x)) for i, x in enumerate(self.loss, 1)]
        return spark.createDataFrame(rows, "epoch int, loss double")


def _digest(key: str, *salt) -> Column:
    return F.md5(F.concat_ws(":", *[F.lit(str(s)) for s in salt], F.col(key).cast("string")))


def word_buckets(posts: DataFrame, features: int, column: str = "text") -> DataFrame:
    """Adds ``buckets``: the hashed words of the whole normalised post."""
    words = F.filter(F.split("normal_text", " "), lambda w: w != "")
    buckets = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))
    return with_normal_text(posts, column).withColumn("buckets", F.coalesce(buckets, F.array().cast("array<int>"))).drop("normal_text")


def inverse_frequencies(rows: DataFrame, features: int) -> np.ndarray:
    """``log((n + 1) / (df + 1))`` of each bucket, one row a bucket to the driver."""
    found = rows.select(F.explode(F.array_distinct("buckets")).alias("b")).groupBy("b").count().toArrow()
    df = np.zeros(features)
    df[found["b"].to_numpy()] = found["count"].to_numpy()
    return np.log((rows.count() + 1) / (df + 1))


def rate_at(step: int, steps: int, rule: Rule) -> float:
    """Rises to ``rate`` over the warm-up, then falls to 0 at the last step."""
    if step <= rule.warmup:
        return rule.rate * step / max(rule.warmup, 1)
    return rule.rate * max(steps - step, 0) / max(steps - rule.warmup, 1)


def margins(values: np.ndarray, offsets: np.ndarray, idf: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Raw outputs of rows whose buckets are ``values[offsets[i]:offsets[i + 1]]``."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.bincount(row, w[values] * idf[values], minlength=len(offsets) - 1) + w[-1]


def run_batches(
    lists: list[np.ndarray], labels: np.ndarray, state: np.ndarray, done: int, steps: int, idf: np.ndarray, rule: Rule, total: float = 0.0
):
    """Batches over rows in order; ``state`` holds weights and both moments. Returns the loss added to ``total``."""
    w, m, v = state
    step = done
    for at in range(0, len(lists), rule.batch):
        part, y = lists[at : at + rule.batch], labels[at : at + rule.batch]
        step += 1
        values = np.concatenate([np.zeros(0, np.int32), *part])
        offsets = np.cumsum([0, *map(len, part)])
        z = margins(values, offsets, idf, w)
        total += float(np.sum(np.logaddexp(0, z) - y * z))
        error = (1 / (1 + np.exp(-z)) - y) / len(part)
        gradient = np.bincount(values, np.repeat(error, np.diff(offsets)) * idf[values], minlength=len(w))
        gradient[-1] = error.sum()
        m *= 0.9
        m += 0.1 * gradient
        v *= 0.999
        v += 0.001 * gradient**2
        rate = rate_at(step, steps, rule)
        w[:-1] *= 1 - rate * rule.decay
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return total


def list_views(column: pa.Array) -> list[np.ndarray]:
    """The lists of whole numbers of a column without a copy."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy()
    return [values[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


def shard_epoch(batches: Iterator[pa.RecordBatch], epoch: int, start: np.ndarray, idf: np.ndarray, rule: Rule) -> Iterator[pa.RecordBatch]:
    """One epoch of each shard in ``batches(shard, size, label, buckets)``, sorted by shard and order.

    Rows stream by: what is held is the state of one shard, one Arrow batch and the rows that
    wait for their mini-batch to fill.
    """
    shard = None

    def packed():
        flat = state.ravel() * size
        parts = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
        loss = [total] + [0.0] * (len(parts) - 1)
        return pa.RecordBatch.from_pydict({"block": np.arange(len(parts)), "part": parts, "loss": loss})

    for batch in batches:
        homes, sizes, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        lists = list_views(batch.column(3))
        edges = [0, *(np.flatnonzero(homes[1:] != homes[:-1]) + 1).tolist(), len(homes)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if i == j:
                continue
            if homes[i] != shard:
                if shard is not None:
                    yield packed()
                shard, size, state, total, seen, wait, marks = homes[i], int(sizes[i]), start.copy(), 0.0, 0, [], np.zeros(0)
            wait, marks = wait + lists[i:j], np.r_[marks, labels[i:j]]
            each = -(-size // rule.batch)
            # The last mini-batch of a shard is the only one that may be short.
            ready = len(wait) if seen + len(wait) == size else len(wait) // rule.batch * rule.batch
            total = run_batches(
                wait[:ready], marks[:ready], state, epoch * each + seen // rule.batch, rule.epochs * each, idf, rule, total
            )
            # Copies, so that an Arrow batch does not stay for the rows that wait.
            seen, wait, marks = seen + ready, [x.copy() for x in wait[ready:]], marks[ready:]
    if shard is not None:
        yield packed()


def train(examples: DataFrame, rule: Rule = Rule(), key: str = "id", column: str = "text") -> Trained:
    """``examples(id, text, label)`` to weights after each epoch."""
    spark = examples.sparkSession
    rows = word_buckets(examples, rule.features, column).select(F.col(key).alias("key"), F.col("label").cast("double"), "buckets")
    rows = cut_lineage(rows, "minibatch-rows")
    n = rows.count()
    trained = Trained(rule, inverse_frequencies(rows, rule.features))
    if not n:
        return trained
    shards = -(-n // rule.shard_rows)
    shard = F.pmod(F.xxhash64(_digest("key", rule.seed, "shard")), F.lit(shards)).cast("int")
    rows = rows.withColumn("shard", shard)
    sizes = cut_lineage(rows.groupBy("shard").agg(F.count("*").alias("size")), "minibatch-shards")
    rows = rows.join(F.broadcast(sizes), "shard")
    idf = spark.sparkContext.broadcast(trained.idf)
    state = np.zeros((3, rule.features + 1))
    for epoch in range(rule.epochs):
        now = spark.sparkContext.broadcast(state)

        def work(batches: Iterator[pa.RecordBatch], epoch=epoch, now=now) -> Iterator[pa.RecordBatch]:
            return shard_epoch(batches, epoch, now.value, idf.value, rule)

        def add(table: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(x, np.float64) for x in table["part"].to_pylist()], axis=0)
            return pa.table({"block": table["block"][:1], "part": [total.tobytes()], "loss": [sum(table["loss"].to_pylist())]})

        kind = "block long, part binary, loss double"
        ordered = rows.withColumn("order", _digest("key", rule.seed, epoch)).repartition("shard")
        sorted_rows = ordered.sortWithinPartitions("shard", "order", "key").select("shard", "size", "label", "buckets")
        parts = sorted_rows.mapInArrow(work, kind).groupBy("block").applyInArrow(add, kind).collect()
        flat = np.concatenate([np.frombuffer(bytes(p["part"]), np.float64) for p in sorted(parts, key=lambda p: p["block"])])
        state = (flat / n).reshape(state.shape)
        trained.weights.append(state[0].copy())
        trained.loss.append(sum(p["loss"] for p in parts) / n)
        now.destroy()
    return trained


def predict(posts: DataFrame, trained: Trained, column: str = "text") -> DataFrame:
    """``posts`` with ``candidate`` (the epoch) and ``predicted``, all epochs in one pass."""
    spark = posts.sparkSession
    model = spark.sparkContext.broadcast((trained.idf, trained.weights))

    @F.pandas_udf("array<int>")
    def classes(buckets: pd.Series) -> pd.Series:
        idf, weights = model.value
        values = np.concatenate([np.zeros(0, np.int32), *buckets])
        offsets = np.cumsum([0, *map(len, buckets)])
        return pd.Series(list(np.array([margins(values, offsets, idf, w) >= 0 for w in weights]).T.astype(np.int32)))

    rows = word_buckets(posts, trained.rule.features, column).withColumn("classes", classes("buckets")).drop("buckets")
    return rows.select(*posts.columns, F.posexplode("classes").alias("candidate", "predicted")).withColumn(
        "candidate", F.col("candidate") + 1
    )


def candidate_metrics(predictions: DataFrame, label: str = "label") -> DataFrame:
    """One row of metrics for each ``candidate``, all from one pass over ``predictions``."""
    cells = predictions.groupBy("candidate").agg(*binary_cells(label, "predicted"))
    return cells.select("candidate", *metrics_of())


def choose(metrics: DataFrame, by: Sequence[str] = ("f1", "accuracy"), patience: int | None = None) -> DataFrame:
    """Adds ``chosen``: the best candidate by ``by``, the first of equals.

    With ``patience`` candidates are epochs, and those after ``patience`` epochs in a row
    without a better first measure are not looked at (early stop). There are few candidates, so one
    window over them is in order.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("candidate")
    measure = F.col(by[0])
    if patience is not None:
        best_before = F.max(measure).over(order.rowsBetween(Window.unboundedPreceding, -1))
        metrics = metrics.withColumn("_better", F.coalesce(measure > best_before, F.lit(True)))
        last = F.max(F.when(F.col("_better"), F.col("candidate"))).over(order)
        metrics = metrics.withColumn("_idle", F.col("candidate") - last)
        idle = F.max("_idle").over(order.rowsBetween(Window.unboundedPreceding, -1))
        metrics = metrics.withColumn("_in", F.coalesce(idle < patience, F.lit(True)))
    else:
        metrics = metrics.withColumn("_in", F.lit(True))
    best = Window.partitionBy(F.lit(0)).orderBy(F.desc("_in"), *[F.desc(c) for c in by], "candidate")
    ranked = metrics.withColumn("chosen", (F.row_number().over(best) == 1) & F.col("_in"))
    return ranked.drop("_in", "_better", "_idle")
