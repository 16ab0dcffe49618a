"""Row-level and key-level operators on posts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kohorta.functions import text as T
from kohorta.operators.skew import salted_join, top_n


def with_full_text(posts: DataFrame, into: str = "text") -> DataFrame:
    """Longest text of each post, from the forms the table holds, which it replaces."""
    fields = set(posts.columns)
    return posts.withColumn(
        into,
        T.full_text(
            F.col("text"),
            F.col("full_text") if "full_text" in fields else None,
            F.col("extended_tweet.full_text") if "extended_tweet" in fields else None,
        ),
    ).drop("full_text", "extended_tweet")


def filter_lang(posts: DataFrame, lang: str = "en") -> DataFrame:
    return posts.filter(F.col("lang") == lang)


def drop_reposts(posts: DataFrame, column: str = "text") -> DataFrame:
    return posts.filter(~T.is_repost(F.col(column)))


def drop_short(posts: DataFrame, min_len: int = 7, column: str = "prep") -> DataFrame:
    """Keep posts of more than ``min_len`` blank-separated tokens."""
    return posts.filter(T.has_more_tokens(F.col(column), min_len))


def track(posts: DataFrame, keywords: Iterable[str], column: str = "text") -> DataFrame:
    """Stream keyword filter; works on batch and streaming frames."""
    return posts.filter(T.matches_track(F.col(column), keywords))


def dedup_posts(
    posts: DataFrame, order: Sequence[Column], keys: Sequence[str] = ("id",)
) -> DataFrame:
    """First row per key in ``order``.

    The rank test sits right above the window, so each map task forwards one row
    per key and a heavily copied post costs one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        posts.withColumn("_copy", F.row_number().over(window))
        .filter(F.col("_copy") == 1)
        .drop("_copy")
    )


def sample_head(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The ``n`` rows with the smallest ``order`` value (a unique, non-null column).

    The cut-off value comes from a scan of that column alone; the wide scan then
    reads the rows at or below it, a test that reaches the Parquet reader.
    """
    head = top_n(df.select(order), [], [F.col(order)], n)
    last = head.agg(F.max(order)).scalar()
    return df.filter(F.col(order) <= last).orderBy(order).limit(n)


def keep_existing(users: DataFrame, directory: DataFrame, key: str = "user_id") -> DataFrame:
    """Users that the directory still knows."""
    return users.join(directory.select(key), key, "left_semi")


def posts_of(posts: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """Posts of the given users; a hot user's posts are split over several tasks."""
    return salted_join(posts, users.select(key), key, "left_semi")


def only_new(incoming: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Incoming rows whose key the store does not hold yet."""
    return incoming.join(known.select(key), key, "left_anti")


def append_new(incoming: DataFrame, known: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The store after an insert-if-absent of ``incoming``."""
    fresh = only_new(dedup_posts(incoming, order), known)
    return known.unionByName(fresh.select(*known.columns))


def distinct_users(posts: DataFrame, key: str = "user_id") -> DataFrame:
    return posts.select(key).distinct()


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count"))


def apply_translations(posts: DataFrame, translations: DataFrame, lang: str = "en") -> DataFrame:
    """Swap in a supplied translation for posts in another language.

    ``translations(id, text_en)`` has one row per id. Posts already in ``lang``
    never meet the join, so they are not shuffled. A post without a language
    counts as foreign.
    """
    own = F.col("lang").eqNullSafe(lang)
    foreign = (
        posts.filter(~own)
        .join(translations.select("id", "text_en"), "id", "left")
        .withColumn("text", F.coalesce("text_en", "text"))
        .select(*posts.columns)
    )
    return posts.filter(own).unionByName(foreign)
