"""Messages that cannot be read are kept with their reason instead of being lost.

One pass over a micro-batch parses each line once and splits it: posts go to the store by
id, rejected lines to a table of their own. Both writes are idempotent for a batch number:
the store adds unseen ids only, and the rejected lines of a batch replace those that an
earlier attempt at it has left. So a batch that failed halfway and is repeated gives each
post and each rejected line once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kohorta.functions import text as T
from kohorta.functions.dates import parse_post_time
from kohorta.sources import schemas
from kohorta.streaming.ingest import DAY_OF_IDS, insert_unseen

_BAD = "__unreadable"


def with_reason(messages: DataFrame, column: str = "value") -> DataFrame:
    """Adds the columns of a post and ``reason``, null for a post that can be read.

    The first that holds: ``empty`` line, ``malformed`` JSON or fields of a wrong kind,
    ``no id``, ``no author``, ``no time`` in the post format, ``no text``.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    post = F.from_json(column, f"{schemas.POST}, {_BAD} string", options)
    parsed = messages.select(F.col(column).alias("line"), post.alias("post")).select("line", "post.*")
    timed = parsed.withColumn("created_ts", parse_post_time(F.col("created_at"))).withColumn("user_id", F.col("user.id"))
    whole = T.full_text(F.col("text"), F.col("full_text"), F.col("extended_tweet.full_text"))
    rules = [
        ("empty", F.col("line").isNull() | (F.trim("line") == "")),
        ("malformed", F.col(_BAD).isNotNull()),
        ("no id", F.col("id").isNull()),
        ("no author", F.col("user_id").isNull()),
        ("no time", F.col("created_ts").isNull()),
        ("no text", whole.isNull()),
    ]
    reason = F.coalesce(*[F.when(test, name) for name, test in rules])
    return timed.withColumn("reason", reason).drop(_BAD)


def write_rejected(rejected: DataFrame, path: str, batch: int) -> None:
    """Lines and reasons of one batch, in place of those of an earlier attempt at it."""
    rejected.select("line", "reason").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("line string, reason string, batch bigint").parquet(path)


def split_batch(
    messages: DataFrame,
    batch: int,
    store: str,
    rejects: str,
    keywords: Iterable[str] | None = None,
    block: int = DAY_OF_IDS,
) -> None:
    """Posts of a micro-batch of raw lines to ``store``, all other lines to ``rejects``."""
    parsed = with_reason(messages).persist()
    try:
        write_rejected(parsed.filter("reason IS NOT NULL"), rejects, batch)
        posts = parsed.filter("reason IS NULL").drop("line", "reason")
        if keywords:
            whole = T.full_text(F.col("text"), F.col("full_text"), F.col("extended_tweet.full_text"))
            posts = posts.filter(T.matches_track(whole, list(keywords)))
        insert_unseen(posts, store, block)
    finally:
        parsed.unpersist()


def start_ingest_with_rejects(
    spark: SparkSession,
    source: str,
    store: str,
    rejects: str,
    checkpoint: str,
    keywords: Iterable[str] | None = None,
    max_files: int | None = None,
    block: int = DAY_OF_IDS,
    available_now: bool = False,
) -> StreamingQuery:
    """Continuous ingest of a folder of message files that keeps what it cannot read."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    writer = reader.load(source).writeStream.foreachBatch(
        lambda messages, batch: split_batch(messages, batch, store, rejects, keywords, block)
    )
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
