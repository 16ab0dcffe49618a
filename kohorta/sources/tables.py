"""Batch readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorta.functions.dates import parse_post_time
from kohorta.sources import schemas


def parse_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages to posts; a message that cannot be read is dropped.

    Readable means: valid JSON, an id, and a time in the post format. Works on
    batch and streaming frames. ``observe`` counts what was dropped.
    """
    parsed = messages.select(F.from_json(column, schemas.POST).alias("post")).select("post.*")
    timed = parsed.withColumn("created_ts", parse_post_time(F.col("created_at"))).withColumn(
        "user_id", F.col("user.id")
    )
    good = F.col("id").isNotNull() & F.col("created_ts").isNotNull()
    counted = timed.observe(
        "ingest",
        F.count(F.lit(1)).alias("messages"),
        F.count(F.when(~good, 1)).alias("dropped"),
    )
    return counted.filter(good)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Batch form of the stream source."""
    return parse_messages(spark.read.text(path))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def find(posts: DataFrame, predicate: Column) -> DataFrame:
    """Predicate scan; tests on stored columns reach the Parquet reader."""
    return posts.filter(predicate)


def insert_many(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Manually labelled posts with ``labels`` renamed to ``label``."""
    options = {"header": True, "multiLine": True, "escape": '"'}
    table = spark.read.schema(schemas.LABELLED).options(**options).csv(path)
    return table.withColumnRenamed("labels", "label")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_periods(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PERIODS).csv(path, header=True)
