"""Exposure / outcome cohorts: from scored posts to counting-process intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohorta.functions import dates as D
from kohorta.operators import posts as P


def daily_flags(scores: DataFrame, exposure: str, outcome: str, thresholds: dict) -> DataFrame:
    """One row per (user, day): posts, any exposure, any outcome.

    Everything the cohort rules ask of a post is settled by its day. Rolling up
    first, with map-side combine, leaves at most one row per user and calendar
    day, so the windows that follow stay small for any user.
    """

    def reached(concept):
        hit = F.coalesce(F.col(f"`{concept}`") >= thresholds[concept], F.lit(False))
        return F.max(hit.cast("int"))

    return (
        scores.filter("normalised_date is not null")
        .groupBy("user_id", "normalised_date")
        .agg(
            F.count("*").alias("posts"),
            reached(exposure).alias("exposed"),
            reached(outcome).alias("hit"),
        )
    )


def build_cohort(
    scores: DataFrame,
    exposure: str,
    outcome: str,
    thresholds: dict,
    min_posts: int = 100,
    months: int = 3,
    outcome_scope: str = "period",
    deduplicate: bool = False,
) -> DataFrame:
    """One row per (user, period): first day, last day, exposure, outcome.

    ``scores`` holds user_id, id, normalised_date and a similarity column for both
    concepts, one row per post as ``clean_text`` leaves it; ``deduplicate`` keeps
    the first of several rows with one id, after the size test.
    Users with more than ``min_posts`` posts count. Periods are ``months`` long
    from the user's first day; an empty one keeps its number and gives no row.
    Posts after the day of the first outcome hit are cut off.
    ``outcome_scope="period"`` sets the outcome on the last kept period only,
    ``"user"`` on every period of the user.
    """
    if outcome_scope not in ("period", "user"):
        raise ValueError("outcome_scope must be 'period' or 'user'")
    copies = None
    if deduplicate:
        copies = scores.groupBy("user_id").agg(F.count("*").alias("_copies"))
        copies = copies.filter(F.col("_copies") > min_posts)
        order = [F.col(f"`{c}`") for c in ("normalised_date", exposure, outcome)]
        scores = P.dedup_posts(scores, order, ["user_id", "id"])
    days = daily_flags(scores, exposure, outcome, thresholds)
    if copies is not None:
        days = P.posts_of(days, copies)
    user = Window.partitionBy("user_id")
    first_hit = F.min(F.when(F.col("hit") == 1, F.col("normalised_date"))).over(user)
    kept = (
        days.withColumns(
            {
                "_size": F.sum("posts").over(user),
                "_t0": F.min("normalised_date").over(user),
                "_end": first_hit,
            }
        )
        .filter(F.lit(copies is not None) | (F.col("_size") > min_posts))
        .filter(F.col("_end").isNull() | (F.col("normalised_date") <= F.col("_end")))
        .withColumn(
            "quarter", D.period_number(F.col("normalised_date"), F.col("_t0"), months)
        )
    )
    in_period = F.max("hit") if outcome_scope == "period" else F.max(F.col("_end").isNotNull().cast("int"))
    return kept.groupBy("user_id", "quarter").agg(
        F.min("normalised_date").alias("d_t0"),
        F.max("normalised_date").alias("date_tn"),
        F.max("exposed").alias("exposition"),
        in_period.alias("outcome"),
    )


def to_intervals(periods: DataFrame) -> DataFrame:
    """Periods to (start, stop] intervals in days at risk.

    A period lasts from its first to its last post; gaps between periods do not
    count. Rows after the first event are cut, and a first interval of no length
    goes. Windows span the periods of one user, a few rows each.
    """
    by_period = Window.partitionBy("user_id").orderBy("quarter")
    upto = by_period.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    user = Window.partitionBy("user_id")
    delta = F.datediff("date_tn", "d_t0").cast("bigint")
    event = F.min(F.when(F.col("outcome") == 1, F.col("quarter"))).over(user)
    return (
        periods.withColumns({"_delta": delta, "_event": event})
        .withColumn("stop", F.sum("_delta").over(upto))
        .withColumn("start", F.col("stop") - F.col("_delta"))
        .filter(F.col("_event").isNull() | (F.col("quarter") <= F.col("_event")))
        .filter(~((F.col("start") == F.col("stop")) & (F.col("start") == 0)))
        .select(
            "user_id",
            F.col("quarter").cast("int").alias("quarter"),
            F.col("start").cast("bigint").alias("start"),
            F.col("stop").cast("bigint").alias("stop"),
            F.col("exposition").cast("int").alias("exposition"),
            F.col("outcome").cast("int").alias("outcome"),
        )
    )
