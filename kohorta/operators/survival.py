"""Risk sets and the Cox proportional-hazards fit on (start, stop] intervals.

Spark does all counting. The intervals collapse at once to one row per (time,
covariate pattern); a Newton step is one aggregation over those rows that hands
the driver a single row with the log-likelihood, the gradient and the Hessian.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kohorta.session import cut_lineage

Z_975 = 1.959963984540054
# Tied events of one time that are unrolled together, and pieces of the time line that
# are summed apart.
TIE_BLOCK = 4096
TIME_PARTS = 1024
KEYS = ("user_id", "quarter", "start", "stop", "outcome")


class CoxError(ValueError):
    """The model cannot be fitted to these intervals."""


def nudge_events(intervals: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Lengthen event rows of no length by half a day, so that they have a risk set."""
    event_now = (F.col("start") == F.col("stop")) & (F.col(outcome) == 1)
    stop = F.col("stop").cast("double")
    return intervals.withColumns(
        {
            "start": F.col("start").cast("double"),
            "stop": F.when(event_now, stop + 0.5).otherwise(stop),
        }
    )


def time_marks(intervals: DataFrame, covariates: Sequence[str], outcome: str = "outcome") -> DataFrame:
    """Net entries and events per (time, covariate pattern).

    An interval enters at ``start`` and leaves at ``stop``. Running sums over the
    times before t then give the risk set at t, without joining times to intervals.
    An interval of no length has no risk set: it adds nothing but, if it holds an
    event, a count in ``flat``.
    """

    def mark(time, net, events, left, flat):
        values = {"t": F.col(time), "net": net, "d": events, "left": left, "flat": flat}
        return F.struct(
            *[(v if n in ("t", "d") else F.lit(v)).alias(n) for n, v in values.items()]
        )

    event = F.coalesce(F.col(outcome).cast("int"), F.lit(0))
    none = F.lit(0)
    pair = F.array(mark("start", 1, none, 0, 0), mark("stop", -1, event, 1, 0))
    flat = F.array(mark("stop", 0, none, 0, 1))
    marks = F.when(F.col("start") < F.col("stop"), pair).when(
        (F.col("start") == F.col("stop")) & (event == 1), flat
    )
    return (
        intervals.select(*covariates, F.explode(marks).alias("m"))
        .groupBy(F.col("m.t").alias("t"), *covariates)
        .agg(*[F.sum(f"m.{c}").alias(c) for c in ("net", "d", "left", "flat")])
    )


def time_span(marks: DataFrame) -> tuple[float, float]:
    """First and last time."""
    row = marks.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    return float(row["low"] or 0), float(row["high"] or 0)


def sums_before(per_time: DataFrame, names: dict[str, str], span: tuple[float, float]) -> DataFrame:
    """Sum of each column of ``names`` over all earlier times, under its new name.

    Two levels, so that no task holds all times: the time line is cut into
    ``TIME_PARTS`` equal parts, whose totals are added up first, then the times of
    each part.
    """
    low, high = span
    width = (high - low) / TIME_PARTS or 1.0
    parted = per_time.withColumn("_part", F.floor((F.col("t").cast("double") - low) / width))
    totals = parted.groupBy("_part").agg(*[F.sum(n).alias(n) for n in names])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_part", *[F.sum(n).over(earlier).alias(f"_base_{n}") for n in names])
    inside = Window.partitionBy("_part").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    rest = [c for c in per_time.columns if c not in names]
    return (
        parted.select("_part", *rest, *[F.sum(n).over(inside).alias(f"_in_{n}") for n in names])
        .join(base, "_part")
        .select(
            *rest,
            *[
                (F.coalesce(f"_base_{n}", zero) + F.coalesce(f"_in_{n}", zero)).alias(new)
                for n, new in names.items()
            ],
        )
    )


def risk_table(
    intervals: DataFrame, exposure: str = "exposition", outcome: str = "outcome"
) -> DataFrame:
    """Per event time: subjects at risk (n), exposed (n1), events (d), exposed events (d1).

    A subject whose interval ends at t is at risk at t, one that starts at t is not.
    """
    # Stored, as the span of times and the sums over them both read it.
    marks = cut_lineage(time_marks(intervals, [exposure], outcome), "marks")
    exposed = F.col(exposure) == 1
    per_time = marks.groupBy("t").agg(
        F.sum("net").alias("_net"),
        F.sum(F.when(exposed, F.col("net")).otherwise(0)).alias("_net1"),
        F.sum("d").alias("d"),
        F.sum(F.when(exposed, F.col("d")).otherwise(0)).alias("d1"),
    )
    return (
        sums_before(per_time, {"_net": "n", "_net1": "n1"}, time_span(per_time))
        .filter(F.col("d") > 0)
        .select("t", "n", "n1", "d", "d1")
    )


@dataclass
class CoxFit:
    covariates: list[str]
    coef: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    null_log_likelihood: float
    intervals: int
    events: int
    dropped_events: int
    iterations: int
    names: tuple = field(
        default=(
            "covariate", "coef", "exp_coef", "se", "ci_low", "ci_high", "exp_low", "exp_high",
            "z", "p", "minus_log2_p",
        ),
        repr=False,
    )
    subjects: int | None = None

    def rows(self) -> list[tuple]:
        out = []
        for j, name in enumerate(self.covariates):
            coef, se = float(self.coef[j]), math.sqrt(self.covariance[j, j])
            z = coef / se
            low, high, p = coef - Z_975 * se, coef + Z_975 * se, math.erfc(abs(z) / math.sqrt(2))
            surprise = -math.log2(p) if p > 0 else math.inf
            out.append(
                (name, coef, math.exp(coef), se, low, high, math.exp(low), math.exp(high), z, p, surprise)
            )
        return out

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row per covariate: coef, exp(coef), se, 95 % intervals of both, z, p, -log2(p)."""
        schema = "covariate string, " + ", ".join(f"{n} double" for n in self.names[1:])
        return spark.createDataFrame(self.rows(), schema)

    @property
    def likelihood_ratio(self) -> float:
        return 2 * (self.log_likelihood - self.null_log_likelihood)

    def statistics(self, spark: SparkSession) -> DataFrame:
        """Size of the fit, partial AIC and the likelihood-ratio test, one row.

        ``subjects`` is null for intervals that name no user.
        """
        k, ratio = len(self.covariates), self.likelihood_ratio
        row = (
            self.subjects, self.intervals, self.events, self.dropped_events, self.log_likelihood,
            2 * k - 2 * self.log_likelihood, ratio, k, chi_square_tail(ratio, k),
        )
        return spark.createDataFrame(
            [row],
            "subjects bigint, intervals bigint, events bigint, dropped_events bigint, "
            "log_likelihood double, partial_aic double, likelihood_ratio double, "
            "degrees_of_freedom int, likelihood_ratio_p double",
        )


def chi_square_tail(x: float, freedom: int) -> float:
    """Probability that a chi-square value is at least ``x``: the upper incomplete gamma
    function, by its series below the mean and by its continued fraction above."""
    a, x = freedom / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    # Convergents p / q, scaled so that neither overflows.
    p_old, q_old, p, q, n, value = 0.0, 1.0, 1.0, x + 1 - a, 0, 0.0
    while True:
        now = p / q
        if abs(now - value) <= 1e-16 * abs(now):
            return now * scale
        value, n = now, n + 1
        up, step = n * (a - n), x + 2 * n + 1 - a
        p_old, q_old, p, q = p / q, 1.0, (step * p + up * p_old) / q, (step * q + up * q_old) / q


def tie_rows(at_event: DataFrame) -> DataFrame:
    """One row per event: ``_tie`` counts the events of a time from 0.

    Blocks of ties are dealt out before they are unrolled, so neither many times nor
    many events of one time meet in a single task. The number of tasks is given: the few
    rows before the unrolling say nothing of those after it.
    """
    tasks = int(at_event.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = at_event.withColumn(
        "_block", F.explode(F.sequence(F.lit(0), ((F.col("d") - 1) / TIE_BLOCK).cast("int")))
    ).repartition(tasks, "t", "_block")
    low = F.col("_block") * F.lit(TIE_BLOCK).cast("bigint")
    return blocks.withColumn(
        "_tie", F.explode(F.sequence(low, F.least(low + TIE_BLOCK, F.col("d")) - 1))
    )


def _newton_terms(marks: DataFrame, x: Sequence[str], centre, beta, span):
    """Log-likelihood, gradient and information at ``beta`` (Efron ties), one job."""
    p = len(x)
    pairs = [(j, k) for j in range(p) for k in range(j, p)]
    dev = [F.col(c).cast("double") - float(m) for c, m in zip(x, centre)]
    score = F.lit(0.0)
    for column, b in zip(dev, beta):
        score = score + column * float(b)
    w = F.exp(score)
    sums = {"d": F.sum("d"), "ds": F.sum(F.col("d") * score)}
    for side, count in (("r", F.col("net")), ("e", F.col("d"))):
        sums[f"{side}0"] = F.sum(count * w)
        for j in range(p):
            sums[f"{side}1_{j}"] = F.sum(count * w * dev[j])
        for j, k in pairs:
            sums[f"{side}2_{j}_{k}"] = F.sum(count * w * dev[j] * dev[k])
    for j in range(p):
        sums[f"dx_{j}"] = F.sum(F.col("d") * dev[j])
    per_time = marks.groupBy("t").agg(*[v.alias(n) for n, v in sums.items()])
    risk = [n for n in sums if n.startswith("r")]
    at_event = sums_before(per_time, {n: n for n in risk}, span).filter("d > 0")
    ties = tie_rows(at_event)
    share = F.col("_tie") / F.col("d")
    s0 = F.col("r0") - share * F.col("e0")
    s1 = [F.col(f"r1_{j}") - share * F.col(f"e1_{j}") for j in range(p)]
    # Sums over events stand on the first of the rows that a time is spread over.
    totals = [
        F.sum(F.when(F.col("_tie") == 0, F.col(n))).alias(n)
        for n in ["ds", *[f"dx_{j}" for j in range(p)]]
    ]
    totals.append(F.sum(F.log(s0)).alias("ll"))
    totals += [F.sum(s1[j] / s0).alias(f"g_{j}") for j in range(p)]
    totals += [
        F.sum(
            (F.col(f"r2_{j}_{k}") - share * F.col(f"e2_{j}_{k}")) / s0 - s1[j] * s1[k] / (s0 * s0)
        ).alias(f"h_{j}_{k}")
        for j, k in pairs
    ]
    row = ties.agg(*totals).first()
    gradient = np.array([row[f"dx_{j}"] - row[f"g_{j}"] for j in range(p)])
    information = np.zeros((p, p))
    for j, k in pairs:
        information[j, k] = information[k, j] = row[f"h_{j}_{k}"]
    return row["ds"] - row["ll"], gradient, information


def cox_fit(
    intervals: DataFrame,
    covariates: Sequence[str] | None = None,
    outcome: str = "outcome",
    zero_length: str = "drop",
    max_iterations: int = 20,
    tolerance: float = 1e-8,
) -> CoxFit:
    """Cox model with time-varying covariates, Efron ties, Newton-Raphson.

    Without ``covariates`` every column that is not a key, a time or the outcome
    is one.
    """
    if covariates is None:
        covariates = [c for c in intervals.columns if c not in (*KEYS, outcome)]
    covariates = list(covariates)
    if not covariates:
        raise CoxError("no covariate")
    if zero_length not in ("drop", "nudge"):
        raise ValueError("zero_length must be 'drop' or 'nudge'")
    if zero_length == "nudge":
        intervals = nudge_events(intervals, outcome)
    marks = cut_lineage(time_marks(intervals, covariates, outcome), "marks")

    numbered = list(enumerate(covariates))
    used = F.col("left") > 0
    size = marks.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("d", "left", "flat")],
        *[(F.sum(F.col("left") * F.col(c)) / F.sum("left")).alias(f"m_{j}") for j, c in numbered],
        *[F.min(F.when(used, F.col(c))).alias(f"low_{j}") for j, c in numbered],
        *[F.max(F.when(used, F.col(c))).alias(f"high_{j}") for j, c in numbered],
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{j}") for j, c in numbered],
    ).first()
    for j, name in numbered:
        if size[f"null_{j}"]:
            raise CoxError(f"covariate {name!r} has nulls")
    if not size["d"]:
        raise CoxError("no event in an interval of positive length")
    for j, name in numbered:
        if size[f"low_{j}"] == size[f"high_{j}"]:
            raise CoxError(f"covariate {name!r} is constant")
    span = time_span(marks)

    centre = [float(size[f"m_{j}"]) for j, _ in numbered]
    beta = np.zeros(len(covariates))
    level, gradient, information = _newton_terms(marks, covariates, centre, beta, span)
    null_level, steps, converged = level, 0, False
    while steps < max_iterations and not converged:
        steps += 1
        try:
            step = np.linalg.solve(information, gradient)
        except np.linalg.LinAlgError as error:
            raise CoxError("covariates are linearly dependent") from error
        if not np.isfinite(step).all() or np.linalg.cond(information) > 1e12:
            raise CoxError("covariates are linearly dependent")
        while True:
            new = _newton_terms(marks, covariates, centre, beta + step, span)
            if new[0] >= level - 1e-9 * abs(level) or np.abs(step).max() < tolerance:
                break
            step = step / 2
        beta, (level, gradient, information) = beta + step, new
        converged = np.abs(step).max() < tolerance
    if not converged:
        raise CoxError(f"no convergence in {max_iterations} steps; an effect may be unbounded")
    subjects = None
    if "user_id" in intervals.columns:
        subjects = intervals.filter("start < stop").select("user_id").distinct().count()
    return CoxFit(
        covariates, beta, np.linalg.inv(information), level, null_level,
        size["left"], size["d"], size["flat"], steps, subjects=subjects,
    )


def cox_summary(intervals: DataFrame, **options) -> DataFrame:
    return cox_fit(intervals, **options).summary(intervals.sparkSession)
