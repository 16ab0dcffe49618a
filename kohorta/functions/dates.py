"""Time stamps, calendar days and drifting three-month periods."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POST_TIME_FORMAT = "MMM d H:m:s Z yyyy"


def parse_post_time(created_at: Column) -> Column:
    """``Wed Aug 27 13:08:45 +0000 2008`` to a timestamp; null when unreadable.

    The weekday is skipped because it carries no information and is no parsable
    pattern letter.
    """
    return F.try_to_timestamp(created_at.substr(F.lit(5), F.length(created_at)), F.lit(POST_TIME_FORMAT))


def to_day(ts: Column) -> Column:
    return F.to_date(ts)


def first_bound(t0: Column, months: int) -> Column:
    """Last day of the first period that opens at ``t0``."""
    return F.date_sub(F.add_months(t0, months), 1)


def period_number(day: Column, t0: Column, months: int = 3) -> Column:
    """1-based number of the period that ``day`` falls into.

    Bounds are chained, each one ``months`` after the one before, so a bound that
    is clamped to the end of a short month stays on the earlier day from then on
    (Sep 30, Dec 30, ...). ``add_months(t0, k * months)`` would miss that drift.

    Whole months decide nearly every day. Only from the 29th on, in a month that
    holds a bound, and if the first bound lies that late too, does the drift matter.
    """
    first = first_bound(t0, months)
    apart = (F.year(day) - F.year(first)) * 12 + F.month(day) - F.month(first)
    passed = F.floor(apart / months).cast("int")
    number = (
        F.when(apart < 0, 0)
        .when(apart % months != 0, passed + 1)
        .when(F.day(first) <= 28, passed + (F.day(day) > F.day(first)).cast("int"))
        .when(F.day(day) <= 28, passed)
        .otherwise(passed + (F.day(day) > _drifted_day(first, passed, months)).cast("int"))
    )
    return (number + 1).cast("int")


def _drifted_day(first: Column, passed: Column, months: int) -> Column:
    """Day of the month on which the bound ``passed`` steps after ``first`` lies.

    It is the least day that any bound so far was clamped to. The calendar months
    of the bounds repeat, and two rounds meet a February of 28 days if the chain
    ever does (but for the rule of the centuries).
    """
    steps = range(1, 2 * 12 // math.gcd(12, months))
    return F.least(
        F.day(first),
        F.day(first),
        *[F.when(passed >= j, F.day(F.add_months(first, months * j))) for j in steps],
    )
