"""Concept scoring: similarity of every post to every concept."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kohorta.functions.vectors import cosine_with
from kohorta.operators.skew import salted_join, top_n

# Concepts travel inside the task closure, in slices of at most so many values (64 MiB).
SLICE_VALUES = 8 << 20


def concept_vectors(concepts: DataFrame, vector: str = "vector") -> dict[str, list[float]]:
    """The concept dictionary, a setting of the study, as name to vector in name order."""
    rows = [(r["concept"], list(r[vector])) for r in concepts.select("concept", vector).toLocalIterator()]
    vectors = dict(sorted(rows))
    if len(vectors) != len(rows):
        raise ValueError("concept names must be unique")
    return vectors


def concept_slices(named: Mapping[str, Sequence[float]], values: int | None = None) -> list[dict]:
    """The dictionary in order, cut into parts of at most ``values`` values, one concept at
    least in each. Every part is scored on its own, so no task holds more."""
    most, parts, size = values or SLICE_VALUES, [{}], 0
    for name, vector in named.items():
        if parts[-1] and size + len(vector) > most:
            parts.append({})
            size = 0
        parts[-1][name] = vector
        size += len(vector)
    return parts


def _vectors(concepts) -> dict[str, list[float]]:
    return dict(concepts) if isinstance(concepts, Mapping) else concept_vectors(concepts)


def score_wide(
    posts: DataFrame, concepts, vector: str = "vector", digits: int | None = 6
) -> DataFrame:
    """One similarity column per concept; the vector column is dropped.

    Scoring runs where the post lies, before any shuffle, so that only the
    resulting doubles travel.
    """
    for named in concept_slices(_vectors(concepts)):
        similarities = cosine_with(list(named.values()))(F.col(vector))
        posts = spread_scores(posts, similarities, named, digits)
    return posts.drop(vector)


def spread_scores(posts, similarities, names, digits: int | None) -> DataFrame:
    scored = posts.withColumn("_scores", similarities)

    def one(position):
        value = F.col("_scores")[position]
        return F.round(value, digits) if digits is not None else value

    return scored.withColumns({name: one(i) for i, name in enumerate(names)}).drop("_scores")


def score_concepts(
    posts: DataFrame, concepts, vector: str = "vector", digits: int | None = 6
) -> DataFrame:
    """Long form: one row per (post, concept), without a join.

    The similarities of a post come back as one array, which is then unnested.
    """
    parts = [
        unnest_scores(posts, cosine_with(list(named.values()))(F.col(vector)), named, vector, digits)
        for named in concept_slices(_vectors(concepts))
    ]
    return reduce(DataFrame.unionByName, parts)


def unnest_scores(posts, similarities, names, vector: str, digits: int | None) -> DataFrame:
    labels = F.array(*[F.lit(name) for name in names])
    pairs = F.arrays_zip(labels.alias("concept"), similarities.alias("similarity"))
    rest = [c for c in posts.columns if c != vector]
    value = F.col("_pair.similarity")
    return posts.select(*rest, F.explode(pairs).alias("_pair")).select(
        *rest,
        F.col("_pair.concept").alias("concept"),
        (F.round(value, digits) if digits is not None else value).alias("similarity"),
    )


def pivot_scores(scores: DataFrame, concepts: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long scores to one column per concept. The names are given, so Spark need
    not scan for them."""
    return scores.groupBy(*keys).pivot("concept", list(concepts)).agg(F.max("similarity"))


def apply_thresholds(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Scores that reach the threshold of their concept.

    All posts have all concepts, so a concept is a hot key. Spark broadcasts the
    thresholds if their size in bytes allows; else the salt splits each concept.
    """
    few = thresholds.select("concept", "threshold")
    joined = salted_join(scores, few, "concept")
    return joined.filter(F.col("similarity") >= F.col("threshold"))


def top_k_per_concept(scores: DataFrame, k: int = 500, key: str = "id") -> DataFrame:
    """The ``k`` highest scores per concept, ties by ``key``; fewer if there are fewer."""
    return top_n(scores, ["concept"], [F.col("similarity").desc(), F.col(key)], k)


def screen_thresholds(scores: DataFrame, text: DataFrame, k: int = 500, key: str = "id") -> DataFrame:
    """Top scores with their text, for choosing a threshold by reading."""
    return top_k_per_concept(scores, k, key).join(text, key)


def compare_encoders(
    posts: DataFrame,
    concepts: DataFrame,
    encoders: Mapping[str, Callable[[Column], Column]],
    vector: str = "vector",
) -> DataFrame:
    """Long scores keyed by encoder, so that encoders do not overwrite each other.

    Each encoder maps the vector column of posts and of concepts alike.
    """
    parts = []
    for name, encode in encoders.items():
        encoded = concepts.select("concept", encode(F.col(vector)).alias(vector))
        part = score_concepts(posts.withColumn(vector, encode(F.col(vector))), encoded, vector)
        parts.append(part.withColumn("encoder", F.lit(name)))
    first, *others = parts
    for part in others:
        first = first.unionByName(part)
    return first


def encoder_summary(scores: DataFrame) -> DataFrame:
    """Count, least, median and greatest similarity per (encoder, concept).

    The median is exact. Rounded similarities take at most two million values, so
    counting them first leaves a bounded histogram to walk through per group,
    whatever the number of posts.
    """
    group = ["encoder", "concept"]
    histogram = scores.groupBy(*group, "similarity").agg(F.count("*").alias("_n"))
    walk = (
        Window.partitionBy(*group)
        .orderBy("similarity")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    whole = Window.partitionBy(*group)
    upto = histogram.withColumn("_upto", F.sum("_n").over(walk)).withColumn(
        "_all", F.sum("_n").over(whole)
    )

    def at(position):
        inside = (F.col("_upto") - F.col("_n") < position) & (position <= F.col("_upto"))
        return F.max(F.when(inside, F.col("similarity")))

    low = F.floor((F.col("_all") + 1) / 2)
    high = F.floor((F.col("_all") + 2) / 2)
    return upto.groupBy(*group).agg(
        F.sum("_n").alias("n"),
        F.min("similarity").alias("min_similarity"),
        ((at(low) + at(high)) / 2).alias("median_similarity"),
        F.max("similarity").alias("max_similarity"),
    )
