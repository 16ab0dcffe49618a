"""Study tables derived from the given ones.

Events stand for posts (user, time), documents for post texts and embeddings for
stored post vectors. All derivations cover whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorta.operators import scoring as S

# Fixed values of the derived study.
EXPOSURE, OUTCOME, ENTRY = "sx", "sy", "sk"
THRESHOLDS = {EXPOSURE: 0.20, OUTCOME: 0.25, ENTRY: 0.33}
MIN_POSTS = 50
ENTRY_KEYWORDS = ["#t1d"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector")
    )


def concepts(spark: SparkSession, folder: str) -> DataFrame:
    """Ten concepts, each with the vector of one embedding."""
    return (
        vectors(spark, folder)
        .filter("id < 10")
        .select(F.concat(F.lit("c"), "id").alias("concept"), "vector")
    )


def thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return (
        vectors(spark, folder)
        .filter("id < 10")
        .select(
            F.concat(F.lit("c"), "id").alias("concept"),
            F.round(0.15 + 0.01 * F.col("id"), 2).alias("threshold"),
        )
    )


def study_vectors(spark: SparkSession, folder: str) -> dict:
    """Exposure, outcome and key concept: embeddings 0, 1 and 2."""
    named = {f"c{i}": name for i, name in enumerate((EXPOSURE, OUTCOME, ENTRY))}
    found = S.concept_vectors(concepts(spark, folder))
    return {name: found[key] for key, name in named.items()}


def scored_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """One row per post with its similarity to the three study concepts.

    One event day counts as thirty calendar days. Event i carries vector i modulo
    the number of vectors; a vector is scored once, and the scores are joined.
    """
    scores = S.score_wide(vectors(spark, folder), study_vectors(spark, folder))
    size = vectors(spark, folder).agg(F.count("*")).scalar()
    day = F.datediff("ts", F.lit("2024-01-01").cast("date")) * 30
    events = table(spark, folder, "events").select(
        "user_id",
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_ts"),
        F.date_add(F.lit("2019-01-01").cast("date"), day).alias("normalised_date"),
        (F.col("event_id") % size).alias("vec_id"),
    )
    return events.join(scores.withColumnRenamed("id", "vec_id"), "vec_id").drop("vec_id")


def decorated(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the marks of posts: mention, repost, hashtag, emoji, link."""
    k = F.col("doc_id")
    text = F.concat(
        F.when(k % 10 == 0, "RT ").otherwise(""),
        F.lit("@user_"), (k % 7).cast("string"), F.lit(" "),
        F.when(k % 4 == 0, "I'm sure they can't, ").when(k % 4 == 1, "we don’t … ").otherwise(""),
        F.when(k % 6 == 0, "my #t1d ").otherwise(""),
        F.when(k % 5 == 0, "\U0001f600 ❤ ").otherwise(""),
        F.col("text"),
        F.when(k % 3 == 0, F.concat(F.lit(" https://t.co/x"), k.cast("string"), F.lit(" tail")))
        .otherwise(""),
    )
    return documents(spark, folder).select(k.alias("id"), "lang", text.alias("text"))


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Scored posts with a text: event i carries document i modulo their number."""
    texts = decorated(spark, folder).withColumnRenamed("id", "doc_id")
    size = table(spark, folder, "documents").agg(F.count("*")).scalar()
    return (
        scored_timeline(spark, folder)
        .withColumn("doc_id", F.col("id") % size)
        .join(texts, "doc_id")
        .drop("doc_id")
    )


def posts_and_texts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Posts without scores, and apart from them the texts that they name by ``text_id``."""
    texts = decorated(spark, folder).withColumnRenamed("id", "text_id")
    size = table(spark, folder, "documents").agg(F.count("*")).scalar()
    events = table(spark, folder, "events").select("user_id", F.col("event_id").alias("id"))
    return events.withColumn("text_id", F.col("id") % size), texts


def raw_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Decorated documents in the three shapes in which a post carries its text."""
    k, whole = F.col("id"), F.col("text")
    return decorated(spark, folder).select(
        "id",
        "lang",
        F.when(k % 2 == 0, whole).otherwise("cut …").alias("text"),
        F.when((k % 2 == 1) & (k % 3 != 0), whole).alias("full_text"),
        F.when((k % 2 == 1) & (k % 3 == 0), F.struct(whole.alias("full_text"))).alias(
            "extended_tweet"
        ),
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return (
        documents(spark, folder)
        .join(table(spark, folder, "labels"), "doc_id")
        .select(
            F.col("doc_id").alias("id"),
            "text",
            F.col("quality").alias("label"),
            (1 - F.col("toxic")).alias("predicted"),
        )
    )
