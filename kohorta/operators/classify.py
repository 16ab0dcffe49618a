"""Personal-experience classifier: split, train, apply, evaluate, select authors."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.functions.text import normalize_post
from kohorta.functions.vectors import class_of, softmax


def _percent(key: Column, seed: int, start: int) -> Column:
    """Stable number 0..99 from eight hex digits of a digest of key and seed."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint") % 100


def split_examples(examples: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """Disjoint test (33 %), validation (20 % of the rest) and train parts.

    The part depends on the key and the seed alone, not on row order, and needs
    no shuffle.
    """
    part = (
        F.when(_percent(F.col(key), seed, 1) < 33, "test")
        .when(_percent(F.col(key), seed, 9) < 20, "validation")
        .otherwise("train")
    )
    return examples.withColumn("part", part)


def with_normal_text(posts: DataFrame, column: str = "text") -> DataFrame:
    return posts.withColumn("normal_text", normalize_post(F.col(column)))


def train_classifier(
    examples: DataFrame,
    column: str = "text",
    features: int = 1 << 16,
    iterations: int = 200,
    regularisation: float = 0.01,
) -> PipelineModel:
    """Hashed TF-IDF on the normalised post and L2 logistic regression.

    ``examples(text, label)``; whole texts are used. The width of the features is
    fixed, so there is neither padding nor truncation. A fit that has not converged
    after ``iterations`` steps is an error.
    """
    stages = [
        RegexTokenizer(inputCol="normal_text", outputCol="tokens", pattern=" ", toLowercase=False),
        HashingTF(inputCol="tokens", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(maxIter=iterations, regParam=regularisation),
    ]
    # Read by the IDF and by every step of the regression; labelled sets are small
    # beside the posts, and a lost block is computed again.
    ready = with_normal_text(examples, column).select("normal_text", "label").persist()
    try:
        model = Pipeline(stages=stages).fit(ready)
        if model.stages[-1].summary.totalIterations >= iterations:
            raise RuntimeError(f"the classifier did not converge in {iterations} steps")
        return model
    finally:
        ready.unpersist()


def loss_gradient(model: PipelineModel, examples: DataFrame, column: str = "text", label: str = "label") -> np.ndarray:
    """Gradient of the training loss at the weights of ``model``; the last entry is the bias.

    The loss is the mean log loss with half the regularisation on the squares of the
    weights, each times its feature's standard deviation, so it is zero where training ends
    and shows a stored model that does not belong to ``examples``. A few sums; a vector of the
    width of the features reaches the driver. Without examples it is all zero.
    """
    regression = model.stages[-1]
    gradient = np.zeros(regression.numFeatures + 1)
    scored = model.transform(with_normal_text(examples, column)).select(
        "features", F.col(label).cast("double").alias("y"), vector_to_array("probability")[1].alias("p")
    )
    # Read by each sum; labelled sets are small beside the posts.
    scored = scored.persist()
    try:
        sums = scored.agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("p").alias("p")).first()
        if not sums.n:
            return gradient
        # Sums of the features weighted by probability and by label; weights must not all be 0.
        for weight, sign in (("p", 1), ("y", -1)):
            if sums[weight]:
                mean = scored.agg(Summarizer.mean(F.col("features"), F.col(weight))).first()[0].toArray()
                gradient[:-1] += sign * sums[weight] / sums.n * mean
        spread = scored.agg(Summarizer.std(F.col("features"))).first()[0].toArray() ** 2
    finally:
        scored.unpersist()
    gradient[:-1] += regression.getRegParam() * spread * regression.coefficients.toArray()
    gradient[-1] = (sums.p - sums.y) / sums.n
    return gradient


def classify(posts: DataFrame, model: PipelineModel, column: str = "text") -> DataFrame:
    """Adds ``p0``, ``p1`` and the predicted class ``personal``."""
    scored = model.transform(with_normal_text(posts, column))
    p = vector_to_array("probability")
    return scored.select(*posts.columns, p[0].alias("p0"), p[1].alias("p1")).withColumn(
        "personal", class_of(F.col("p0"), F.col("p1"))
    )


def classify_logits(posts: DataFrame, logits: str = "logits") -> DataFrame:
    """Class from the two raw outputs of a user's own network."""
    p = softmax(F.col(logits))
    return posts.withColumns({"p0": p[0], "p1": p[1]}).withColumn(
        "personal", class_of(F.col("p0"), F.col("p1"))
    )


def save_classifier(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_classifier(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def binary_cells(label: str, predicted: str) -> list[Column]:
    """Aggregates ``tp, fp, fn, tn`` of class 1."""

    def cell(actual, guess):
        return F.count(F.when((F.col(label) == actual) & (F.col(predicted) == guess), 1))

    return [
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn")
    ]


def metrics_of() -> list[Column]:
    """The four cells with accuracy, precision, recall and F1; 0 where undefined."""

    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return [
        tp, fp, fn, tn,
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def binary_metrics(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 in one pass; 0 where undefined."""
    return df.agg(*binary_cells(label, predicted)).select(*metrics_of())


def evaluate(model: PipelineModel, test: DataFrame, column: str = "text") -> DataFrame:
    return binary_metrics(classify(test, model, column), "label", "personal")


def select_authors(predicted: DataFrame, label: str = "personal") -> DataFrame:
    """Distinct authors of the posts in class 1."""
    author = "user_id" if "user_id" in predicted.columns else "user.id"
    return predicted.filter(F.col(label) == 1).select(F.col(author).alias("user_id")).distinct()
