"""Text embeddings behind one interface."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, VectorSlicer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

from kohorta.functions.vectors import cosine_with
from kohorta.operators.scoring import concept_slices, spread_scores, unnest_scores
from kohorta.operators.skew import salted_join


# Features of the concepts that are scored together, at most.
MATRIX_FEATURES = 2048


def fit_tfidf(texts: DataFrame, column: str = "prep", features: int = 1 << 18) -> PipelineModel:
    """Hashed TF-IDF encoder with unit length, fitted on a table of texts."""
    stages = [
        RegexTokenizer(inputCol=column, outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_unit"),
    ]
    return Pipeline(stages=stages).fit(texts.select(column))


def network_encoder(make_predict: Callable, batch_size: int = 32):
    """Encoder from a user's own network.

    ``make_predict()`` runs once per Python worker and returns a function from an
    array of texts to a matrix of vectors.
    """
    return predict_batch_udf(
        make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size
    )


def embed(df: DataFrame, encoder, column: str = "prep", into: str = "vector") -> DataFrame:
    """Adds a vector column: ``encoder`` is a fitted pipeline, a column function
    (a network or stored vectors), or the name of a vector column.

    A pipeline's vectors become dense here, so give it few features; to score
    texts against concepts use ``score_texts``, which keeps them sparse.
    """
    if isinstance(encoder, PipelineModel):
        out = encoder.transform(df)
        unit = vector_to_array(F.col("_unit"), "float32")
        return out.select(*df.columns, unit.alias(into))
    if isinstance(encoder, str):
        return df.withColumn(into, F.col(encoder))
    return df.withColumn(into, encoder(F.col(column)))


def embed_concepts(concepts: DataFrame, encoder) -> DataFrame:
    """Concept dictionary to ``(concept, vector)``: each keyword list is encoded once."""
    texts = concepts.select("concept", F.array_join("keywords", ", ").alias("prep"))
    return embed(texts, encoder).select("concept", "vector")


def score_texts(
    texts: DataFrame,
    encoder: PipelineModel,
    concepts: DataFrame,
    column: str = "prep",
    digits: int | None = 6,
    wide: bool = False,
) -> DataFrame:
    """Scores of texts against ``concepts(concept, keywords)`` with a TF-IDF encoder,
    one row per concept or, if ``wide``, one column.

    Only the features that occur in some concept can add to a product. The sparse
    unit vector of a text is sliced to those, a few hundred, before it leaves the
    JVM; its length was fixed before, so the cosine is unchanged.
    """
    keyword_text = concepts.select("concept", F.array_join("keywords", ", ").alias(column))
    encoded = encoder.transform(keyword_text).select("concept", "_unit").toLocalIterator()
    weights = {}
    for r in encoded:
        indices = [int(i) for i in r["_unit"].indices]
        weights[r["concept"]] = dict(zip(indices, map(float, r["_unit"].values), strict=True))
    # A part holds few enough concepts that its matrix, concepts by features, stays small.
    parts = concept_slices(dict(sorted(weights.items())), MATRIX_FEATURES)
    frame = encoder.transform(texts).select(*texts.columns, "_unit")
    frames = []
    for named in parts:
        used = sorted({i for w in named.values() for i in w}) or [0]
        matrix = [[w.get(i, 0.0) for i in used] for w in named.values()]
        sliced = VectorSlicer(inputCol="_unit", outputCol="_part", indices=used).transform(frame)
        similarities = cosine_with(matrix, unit_rows=True)(vector_to_array("_part"))
        if wide:
            frame = spread_scores(sliced, similarities, named, digits).drop("_part")
        else:
            frames.append(unnest_scores(sliced.drop("_unit", column), similarities, named, "_part", digits))
    return frame.drop("_unit", column) if wide else reduce(DataFrame.unionByName, frames)


def text_words(text: Column) -> Column:
    """The lower-case words of a text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def word_buckets(words: pa.Array, features: int) -> np.ndarray:
    """Bucket of each word, by a digest that any engine has; a repeated word is digested once."""
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    own = [int.from_bytes(hashlib.md5(w, usedforsecurity=False).digest()[:4], "big") % features for w in distinct]
    return np.array(own, np.int64)[coded.indices.to_numpy()]


def _bucket_counts(texts: DataFrame, key: str, text: Column, features: int) -> DataFrame:
    """``(key, bucket, _tf)``, in partitions by key.

    Words are counted where the texts are read, a batch at a time, so one row for each text
    and bucket travels, and one for all texts of a key that meet in a batch.
    """
    source = texts.select(F.col(key), text_words(text).alias("_words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            keys = batch.column(0).dictionary_encode(null_encoding="encode")
            owner = np.repeat(keys.indices.to_numpy(), np.diff(lists.offsets.to_numpy()))
            pairs = owner * np.int64(features) + word_buckets(lists.flatten(), features)
            pairs, many = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [keys.dictionary.take(pa.array(pairs // features)), pa.array(pairs % features), pa.array(many)],
                names=[key, "bucket", "_tf"],
            )

    kinds = StructType(
        [StructField(key, source.schema[key].dataType), StructField("bucket", LongType()), StructField("_tf", LongType())]
    )
    counted = source.mapInArrow(count, kinds).repartition(key)
    return counted.groupBy(key, "bucket").agg(F.sum("_tf").alias("_tf"))


def _frequencies(counts: DataFrame) -> DataFrame:
    """``(bucket, _df)``. It counts the column that the weights read, too, so Spark deals the
    counts out once for both."""
    return counts.groupBy("bucket").agg(F.count("_tf").alias("_df"))


def _unit_weights(counts: DataFrame, frequencies: DataFrame, size: int, key: str) -> DataFrame:
    """``(key, bucket, weight)`` with unit length per key; the frequencies, as many as there
    are buckets at most, are broadcast, so the counts stay where they are."""
    idf = F.log(F.lit(size + 1.0) / (F.coalesce("_df", F.lit(0)) + 1))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return (
        counts.join(F.broadcast(frequencies), "bucket", "left")
        .withColumn("_w", F.col("_tf") * idf)
        .select(key, "bucket", F.when(norm > 0, F.col("_w") / norm).otherwise(0.0).alias("weight"))
    )


def tfidf_rows(texts: DataFrame, column: str = "prep", key: str = "id", features: int = 1 << 18) -> DataFrame:
    """Sparse TF-IDF at full width, one row per text and bucket it has.

    ``weight`` is term count times ``ln((texts + 1) / (texts with the bucket + 1))``,
    scaled to unit length. Rows of one key count as one text.
    """
    counts = _bucket_counts(texts, key, F.col(column), features)
    frequencies = _frequencies(counts)
    return _unit_weights(counts, frequencies, texts.select(key).distinct().count(), key)


def score_sparse(
    texts: DataFrame,
    concepts: DataFrame,
    column: str = "prep",
    key: str = "id",
    features: int = 1 << 18,
    digits: int = 6,
) -> DataFrame:
    """Cosine of each text with each concept of ``concepts(concept, keywords)``.

    Texts and concepts are weighted by the frequencies of the texts. Only buckets that
    some concept has are multiplied; a text without them scores 0.
    """
    counts = _bucket_counts(texts, key, F.col(column), features)
    frequencies = _frequencies(counts)
    size = texts.select(key).distinct().count()
    keywords = F.array_join("keywords", ", ")
    ours = _unit_weights(
        _bucket_counts(concepts, "concept", keywords, features), frequencies, size, "concept"
    ).withColumnRenamed("weight", "_part")
    products = (
        salted_join(_unit_weights(counts, frequencies, size, key), ours, "bucket")
        .groupBy(key, "concept")
        .agg(F.sum(F.col("weight") * F.col("_part")).alias("_sum"))
    )
    names = F.array(*[F.lit(r[0]) for r in concepts.select("concept").orderBy("concept").collect()])
    grid = texts.select(key).distinct().select(key, F.explode(names).alias("concept"))
    return grid.join(products, [key, "concept"], "left").select(
        key, "concept", (F.round(F.coalesce("_sum", F.lit(0.0)), digits) + 0.0).alias("similarity")
    )
