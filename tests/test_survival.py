import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from kohorta.operators import survival as V


def frame(spark, rows, names=("x",)):
    schema = "user_id int, quarter int, start bigint, stop bigint, outcome int, "
    return spark.createDataFrame(rows, schema + ", ".join(f"{n} double" for n in names))


def random_rows(seed, users=60, width=1, span=15, binary=True):
    rng = np.random.default_rng(seed)
    rows = []
    for user in range(users):
        at = 0
        for quarter in range(1, rng.integers(2, 5)):
            stop = at + int(rng.integers(0, span))
            x = rng.integers(0, 2, width) if binary else rng.normal(size=width).round(2)
            event = int(rng.random() < 0.4)
            rows.append((user, quarter, at, stop, event, *map(float, x)))
            at = stop
            if event:
                break
    return rows


def brute_risk(rows):
    usable = [r for r in rows if r[2] < r[3]]
    out = []
    for t in sorted({r[3] for r in usable if r[4] == 1}):
        at_risk = [r for r in usable if r[2] < t <= r[3]]
        events = [r for r in at_risk if r[4] == 1 and r[3] == t]
        assert len({r[0] for r in at_risk}) == len(at_risk)  # nobody counts twice
        out.append(
            (t, len(at_risk), sum(r[5] == 1 for r in at_risk), len(events),
             sum(r[5] == 1 for r in events))
        )
    return out


def brute_cox(rows, steps=40):
    """Efron partial likelihood, maximised by Newton on the plain definition."""
    usable = [r for r in rows if r[2] < r[3]]
    x = np.array([r[5:] for r in usable])
    start, stop, event = (np.array([r[i] for r in usable]) for i in (2, 3, 4))
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        gradient, information, level = np.zeros(len(beta)), np.zeros((len(beta),) * 2), 0.0
        w = np.exp(x @ beta)
        for t in np.unique(stop[event == 1]):
            risk = (start < t) & (t <= stop)
            dead = risk & (event == 1) & (stop == t)
            d = dead.sum()
            level += (x[dead] @ beta).sum()
            gradient += x[dead].sum(axis=0)
            for tie in range(d):
                weight = np.where(dead, 1 - tie / d, 1.0) * w * risk
                s0, s1 = weight.sum(), weight @ x
                mean = s1 / s0
                gradient -= mean
                information += (x.T * weight) @ x / s0 - np.outer(mean, mean)
                level -= np.log(s0)
        beta = beta + np.linalg.solve(information, gradient)
    return beta, np.sqrt(np.diag(np.linalg.inv(information))), level


@settings(max_examples=4, deadline=None)
@given(seed=st.integers(0, 10**6))
def test_risk_table_equals_the_definition(spark, seed):
    rows = random_rows(seed)
    out = V.risk_table(frame(spark, rows), "x").orderBy("t").collect()
    assert [tuple(r) for r in out] == brute_risk(rows)


@pytest.mark.parametrize(
    "width, binary, span, parts, block",
    [(1, True, 15, 1, 10**6), (1, True, 4, 3, 2), (2, True, 10, 1024, 10**6), (3, False, 10, 7, 2)],
)
def test_fit_equals_the_definition(spark, monkeypatch, width, binary, span, parts, block):
    """Few and many marks, few and many ties per time give the same answer."""
    monkeypatch.setattr(V, "TIME_PARTS", parts)
    monkeypatch.setattr(V, "TIE_BLOCK", block)
    rows = random_rows(11 * width + span, width=width, binary=binary, span=span)
    names = [f"x{i}" for i in range(width)]
    fit = V.cox_fit(frame(spark, rows, names))
    beta, se, level = brute_cox(rows)
    assert fit.covariates == names
    assert np.allclose(fit.coef, beta, atol=1e-7)
    assert np.allclose(np.sqrt(np.diag(fit.covariance)), se, atol=1e-7)
    assert fit.events == sum(r[4] for r in rows if r[2] < r[3])
    assert fit.dropped_events == sum(r[4] for r in rows if r[2] == r[3])
    # The level is reported for centred covariates, which leaves it unchanged.
    assert fit.log_likelihood == pytest.approx(level, abs=1e-6)


def test_no_ties(spark):
    rows = [(i, 1, 0, i + 1, int(i % 3 > 0), float(i % 2)) for i in range(20)]
    beta, se, _ = brute_cox(rows)
    summary = V.cox_summary(frame(spark, rows)).first()
    assert summary.covariate == "x" and summary.coef == pytest.approx(beta[0], abs=1e-7)
    assert summary.se == pytest.approx(se[0], abs=1e-7)
    assert summary.exp_coef == pytest.approx(np.exp(beta[0]))
    assert summary.ci_low < summary.coef < summary.ci_high and 0 < summary.p < 1


@pytest.mark.parametrize(
    ("x", "freedom", "tail"),
    [(3.841458820694124, 1, 0.05), (0.0, 3, 1.0), (0.5, 1, 0.4795001221869535), (2.0, 2, 0.36787944117144233),
     (18.307038053275146, 10, 0.05), (100.0, 2, 1.9287498479639178e-22), (700.0, 1, 2.8e-154)],
)
def test_chi_square_tail(x, freedom, tail):
    """Fixed points: table values and exp(-x / 2) for two degrees."""
    if x == 700.0:
        tail = math.erfc(math.sqrt(x / 2))
    assert V.chi_square_tail(x, freedom) == pytest.approx(tail, rel=1e-9)


def test_statistics_of_the_fit(spark):
    rows = random_rows(7)
    fit = V.cox_fit(frame(spark, rows))
    got = fit.statistics(spark).first()
    assert got.subjects == len({r[0] for r in rows if r[2] < r[3]}) and got.degrees_of_freedom == 1
    assert got.partial_aic == pytest.approx(2 - 2 * fit.log_likelihood)
    assert got.likelihood_ratio_p == pytest.approx(math.erfc(math.sqrt(got.likelihood_ratio / 2)))
    row = fit.summary(spark).first()
    assert row.exp_low == pytest.approx(math.exp(row.ci_low)) and row.exp_high == pytest.approx(math.exp(row.ci_high))
    assert row.minus_log2_p == pytest.approx(-math.log2(row.p))


def test_nudge_keeps_events_of_no_length(spark):
    rows = random_rows(5, span=3)
    flat = sum(r[4] for r in rows if r[2] == r[3])
    nudged = [(*r[:3], r[3] + 0.5, *r[4:]) if r[2] == r[3] and r[4] else r for r in rows]
    fit = V.cox_fit(frame(spark, rows), zero_length="nudge")
    assert flat > 0 and fit.dropped_events == 0
    assert np.allclose(fit.coef, brute_cox(nudged)[0], atol=1e-7)


@pytest.mark.parametrize(
    "rows, message",
    [
        ([(1, 1, 0, 5, 0, 1.0), (2, 1, 0, 5, 0, 0.0)], "no event"),
        ([(1, 1, 0, 5, 1, 1.0), (2, 1, 0, 6, 1, 1.0)], "constant"),
        ([(1, 1, 0, 5, 1, None), (2, 1, 0, 6, 1, 1.0)], "nulls"),
        ([(1, 1, 0, 5, 1, 1.0), (2, 1, 0, 6, 1, 1.0), (3, 1, 0, 9, 0, 0.0)], "unbounded|dependent"),
    ],
)
def test_clear_errors(spark, rows, message):
    with pytest.raises(V.CoxError, match=message):
        V.cox_fit(frame(spark, rows))


def test_linear_dependence(spark):
    rows = [(*r, 1 - r[5]) for r in random_rows(3)]
    with pytest.raises(V.CoxError, match="dependent"):
        V.cox_fit(frame(spark, rows, ["x", "y"]))


def test_tie_rows_spread_over_tasks(spark):
    """A thousand times of a thousand events each: no task unrolls them all."""
    at_event = spark.range(1000).selectExpr("id AS t", "1000L AS d").coalesce(1)
    tasks = V.tie_rows(at_event).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in tasks) == 1_000_000 and max(r["count"] for r in tasks) < 500_000
    one_time = spark.createDataFrame([(1, 1_000_000)], "t long, d long")
    assert len(V.tie_rows(one_time).select(F.spark_partition_id()).distinct().collect()) > 1


def test_sums_before_equal_a_running_sum(spark):
    rows = [(float(t) / 7, t % 5) for t in range(5000)]
    frame = spark.createDataFrame(rows, "t double, n long").repartition(4)
    got = V.sums_before(frame, {"n": "s"}, V.time_span(frame)).orderBy("t").collect()
    total = 0
    for (t, n), r in zip(rows, got, strict=True):
        assert r.t == t and r.s == total
        total += n
