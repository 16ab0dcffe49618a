"""Continuous ingest of keyword posts with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kohorta.functions import text as T
from kohorta.operators import posts as P
from kohorta.sources.tables import parse_messages

# One day of time-ordered ids (milliseconds in the bits above 22).
DAY_OF_IDS = 86_400_000 << 22
# Tasks that write one block of a batch.
BLOCK_PARTS = 2


def read_posts_stream(
    spark: SparkSession,
    path: str,
    keywords: Iterable[str] | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Posts from a folder that message files drop into, one JSON object per line.

    Keywords are looked for in the whole post, wherever the message carries it.
    """
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    posts = parse_messages(reader.load(path))
    if not keywords:
        return posts
    whole = T.full_text(F.col("text"), F.col("full_text"), F.col("extended_tweet.full_text"))
    return posts.filter(T.matches_track(whole, keywords))


def with_id_block(posts: DataFrame, block: int = DAY_OF_IDS) -> DataFrame:
    """Partition column that depends on the id alone, so all copies share a block."""
    return posts.withColumn("id_block", F.floor(F.col("id") / F.lit(block)).cast("bigint"))


def known_ids(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame | None:
    """Ids of the store in the blocks of ``batch``, or None if there is no store yet.

    The join on the partition column prunes partitions when it runs, and the range of
    blocks, one row to the driver, prunes them before.
    """
    blocks = batch.select("id_block").distinct()
    ends = blocks.agg(F.min("id_block").alias("lo"), F.max("id_block").alias("hi")).first()
    try:
        store = spark.read.schema("id bigint, id_block bigint").parquet(path)
        near = store.filter(F.col("id_block").between(ends["lo"], ends["hi"]))
        return near.join(blocks, "id_block", "left_semi").select("id")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def by_block(posts: DataFrame) -> DataFrame:
    """Rows of a block in at most ``BLOCK_PARTS`` tasks, hence files, of one write."""
    part = F.pmod(F.xxhash64("id"), F.lit(BLOCK_PARTS))
    return posts.repartition("id_block", part)


def insert_unseen(batch: DataFrame, path: str, block: int = DAY_OF_IDS) -> None:
    """Append the posts of a micro-batch whose id the store has never seen.

    Only the store partitions that the batch's ids fall into are read. A batch
    repeated after a failure finds its own rows and adds nothing.
    """
    once = P.dedup_posts(with_id_block(batch, block), [F.col("created_ts")]).persist()
    try:
        if once.isEmpty():
            return
        known = known_ids(batch.sparkSession, path, once)
        fresh = once if known is None else P.only_new(once, known)
        by_block(fresh).write.mode("append").partitionBy("id_block").parquet(path)
    finally:
        once.unpersist()


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Copy a store into ``target`` with few files per block; for use between runs."""
    store = spark.read.parquet(path)
    by_block(store).write.mode("errorifexists").partitionBy("id_block").parquet(target)


def start_ingest(
    posts: DataFrame,
    path: str,
    checkpoint: str,
    horizon: str | None = None,
    block: int = DAY_OF_IDS,
    available_now: bool = False,
) -> StreamingQuery:
    """Write each post once.

    Without ``horizon`` an id is checked against the whole store, however old its
    first copy. With it, copies are recognised by stream state only, for that long
    after the first has arrived, which needs no look-up. Arrival counts, not the time
    a post bears: a late post is kept, and a clock that runs ahead discards nothing.
    A failing source stops the query.
    """
    if horizon:
        arrived = posts.withColumn("_arrived", F.current_timestamp())
        unique = (
            arrived.withWatermark("_arrived", horizon)
            .dropDuplicatesWithinWatermark(["id"])
            .drop("_arrived")
        )
        writer = (
            with_id_block(unique, block)
            .writeStream.format("parquet")
            .outputMode("append")
            .partitionBy("id_block")
            .option("path", path)
        )
    else:
        writer = posts.writeStream.foreachBatch(
            lambda batch, _number: insert_unseen(batch, path, block)
        )
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
