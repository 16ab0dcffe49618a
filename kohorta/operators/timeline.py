"""Per-user timelines: collection, cleaning, entry time, truncation.

No operator here sorts a whole user in one task. Facts about a user (count, first
day, first hit) are aggregates with map-side combine, joined back to the posts by a
join that splits hot users.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kohorta.functions import dates as D
from kohorta.functions import text as T
from kohorta.operators import posts as P
from kohorta.operators.skew import salted_join, top_n
from kohorta.session import cut_lineage


def latest_per_user(posts: DataFrame, n: int = 3240) -> DataFrame:
    """The ``n`` newest distinct ids of each user, all columns; posts of no user drop out.

    The n-th newest id is found on the (user, id) columns alone and joined back as a
    lower limit; a user with fewer ids has none. The input is read twice, the second
    time whole, and full rows are shuffled only if the limits outgrow a broadcast.
    """
    posts = posts.filter("id is not null and user_id is not null")
    ids = posts.select("user_id", "id").distinct()
    limits = top_n(ids, ["user_id"], [F.col("id").desc()], n).filter(F.col("rank") == n)
    limits = limits.select("user_id", F.col("id").alias("_oldest"))
    return (
        salted_join(posts, limits, "user_id", "left")
        .filter(F.col("_oldest").isNull() | (F.col("id") >= F.col("_oldest")))
        .select(*posts.columns)
    )


def build_timelines(
    posts: DataFrame, users: DataFrame, n: int = 3240, texts: DataFrame | None = None, key: str = "text_id"
) -> DataFrame:
    """Timelines of selected users: latest ``n`` posts each, reposts left out.

    The posts of the users are stored first, so all posts are read once. Texts that are
    kept apart, as ``texts(key, text, …)``, are fetched for the latest posts alone; a post
    whose text is not there does not count among them.
    """
    if texts is not None:
        posts = posts.join(texts.select(key), key, "left_semi")
    own = cut_lineage(P.posts_of(posts, users), "author-posts")
    latest = latest_per_user(own, n)
    if texts is not None:
        latest = latest.join(texts, key).drop(key)
    return P.drop_reposts(latest)


def clean_text(
    posts: DataFrame,
    order: Iterable[Column] = (),
    min_len: int = 7,
    expand: bool = False,
    flags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Full text, one row per id, links, reposts and mentions out, short posts out.

    The kept copy of an id is the first in ``order``; ties fall to a digest of the
    text, so the result does not depend on row placement. Texts are cleaned where they
    are read. A copy to be dropped travels without its text, as it may still be the
    first of its id, and raw texts do not travel unless somebody asks for them.
    Contractions come last because they would change the token count.
    ``flags``, columns over the cleaned text ``prep``, take the place of the texts: they are
    worked out where a text is read, and no text travels.
    """
    texts = P.with_full_text(posts)
    short = lambda t: F.when(T.has_more_tokens(t, min_len), t)
    cleaned = T.bind(
        T.cut_at_url(F.col("text")),
        lambda cut: F.when(~T.is_repost(cut), T.bind(T.strip_mentions(cut), short)),
    )
    texts = texts.withColumns({"prep": cleaned, "_digest": F.unhex(F.md5("text"))})
    whole = T.expand_contractions(F.col("prep")) if expand else F.col("prep")
    if flags:
        flagged = texts.withColumns({"_kept": F.col("prep").isNotNull(), "prep": whole})
        texts = flagged.withColumns(dict(flags)).drop("text", "prep")
    unique = P.dedup_posts(texts, [*order, F.col("_digest").asc_nulls_last()]).drop("_digest")
    if flags:
        return unique.filter("_kept").drop("_kept")
    kept = unique.filter("prep is not null")
    return kept.withColumn("prep", whole) if expand else kept


def with_days(posts: DataFrame) -> DataFrame:
    """Parsed time and calendar day; posts without a readable time are dropped."""
    if "created_ts" not in posts.columns:
        posts = posts.withColumn("created_ts", D.parse_post_time(F.col("created_at")))
    return posts.filter(F.col("created_ts").isNotNull()).withColumn(
        "normalised_date", D.to_day(F.col("created_ts"))
    )


def clean_timelines(posts: DataFrame, min_len: int = 7) -> DataFrame:
    """All cleaning steps of a timeline, ready for scoring."""
    return clean_text(with_days(posts), [F.col("created_ts")], min_len, expand=True)


def min_timeline(posts: DataFrame, n: int = 100) -> DataFrame:
    """Posts of users that have more than ``n`` of them."""
    sizes = posts.groupBy("user_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > n)
    return P.posts_of(posts, sizes)


def timeline_span(posts: DataFrame) -> DataFrame:
    """First day, last day and post count per user."""
    return posts.groupBy("user_id").agg(
        F.min("normalised_date").alias("t0"),
        F.max("normalised_date").alias("tn"),
        F.count("*").alias("n_posts"),
    )


def timeline_positions(posts: DataFrame) -> DataFrame:
    """0-based position of each post in its user's timeline, ordered by time and id.

    Three rounds instead of one sort per user: rank inside (user, minute), then add the
    posts of earlier minutes of the day and of earlier days, two running sums over at
    most 1,440 rows and one row per day. So not even a burst of one day meets in one
    task. Posts without a time have no position and are left out.
    """
    timed = posts.filter("created_ts is not null and user_id is not null").withColumns(
        {"_minute": F.date_trunc("minute", "created_ts"), "_day": F.to_date("created_ts")}
    )
    inside = Window.partitionBy("user_id", "_minute").orderBy("created_ts", "id")

    def earlier(order, *group):
        return Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    minutes = timed.groupBy("user_id", "_day", "_minute").agg(F.count("*").alias("_n"))
    days = minutes.groupBy("user_id", "_day").agg(F.sum("_n").alias("_n"))
    before_day = days.select(
        "user_id", "_day", F.sum("_n").over(earlier("_day", "user_id")).alias("_days")
    )
    offsets = (
        minutes.withColumn("_minutes", F.sum("_n").over(earlier("_minute", "user_id", "_day")))
        .join(before_day, ["user_id", "_day"])
        .select(
            "user_id",
            "_minute",
            (F.coalesce("_days", F.lit(0)) + F.coalesce("_minutes", F.lit(0))).alias("_before"),
        )
    )
    return (
        timed.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, ["user_id", "_minute"])
        .withColumn("position", F.col("_before") + F.col("_rank") - 1)
        .select(*posts.columns, "position")
    )


def first_hit(posts: DataFrame, hit: Column) -> DataFrame:
    """Time and id of each user's first post that satisfies ``hit``.

    A post without a time is no entry: its place in the timeline is unknown.
    """
    return (
        posts.filter(hit & F.col("created_ts").isNotNull())
        .groupBy("user_id")
        .agg(F.min(F.struct("created_ts", "id")).alias("_first"))
        .select(
            "user_id", F.col("_first.created_ts").alias("t0_ts"), F.col("_first.id").alias("t0_id")
        )
    )


def entry_hit(
    threshold: float,
    keywords: Iterable[str] = (),
    similarity: str = "similarity",
    column: str = "prep",
) -> Column:
    """The similarity to the key concept reaches ``threshold``, or a keyword occurs.

    A missing similarity or text is no hit.
    """
    similar = F.coalesce(F.col(similarity) >= threshold, F.lit(False))
    return similar | F.coalesce(T.has_keyword(F.col(column), keywords), F.lit(False))


def define_t0(posts: DataFrame, hit: Column) -> DataFrame:
    """Each user's posts from the entry time on; users without a hit disappear, and so do
    posts without a time.

    Entry is the first post, by time and id, that satisfies ``hit``. The posts are
    read twice, so a costly test is better stored as a flag first.
    """
    entry = first_hit(posts, hit)
    later = (F.col("created_ts") > F.col("t0_ts")) | (
        (F.col("created_ts") == F.col("t0_ts")) & (F.col("id") >= F.col("t0_id"))
    )
    return salted_join(posts, entry, "user_id").filter(later).select(*posts.columns)


def truncate_at_outcome(posts: DataFrame, hit: Column) -> DataFrame:
    """Posts up to and including the day of the user's first outcome hit."""
    first = posts.filter(hit).groupBy("user_id").agg(F.min("normalised_date").alias("_end"))
    return (
        salted_join(posts, first, "user_id", "left")
        .filter(F.col("_end").isNull() | (F.col("normalised_date") <= F.col("_end")))
        .select(*posts.columns)
    )


def assign_periods(posts: DataFrame, months: int = 3) -> DataFrame:
    """Period number of every post, counted from the user's first day.

    Posts without a day are dropped.
    """
    dated = posts.filter("normalised_date is not null")
    first = dated.groupBy("user_id").agg(F.min("normalised_date").alias("_t0"))
    return (
        salted_join(dated, first, "user_id")
        .withColumn("quarter", D.period_number(F.col("normalised_date"), F.col("_t0"), months))
        .drop("_t0")
    )
