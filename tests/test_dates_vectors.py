import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kohorta.functions import dates as D
from kohorta.functions import vectors as V


def test_parse_post_time(values):
    texts = ["Wed Aug 27 13:08:45 +0000 2008", "Wed Aug 27 13:08:45 +0200 2008", "nonsense", "", None]
    times = values(lambda c: F.date_format(D.parse_post_time(c), "yyyy-MM-dd HH:mm:ss"), texts)
    assert times == ["2008-08-27 13:08:45", "2008-08-27 11:08:45", None, None, None]


def add_months(day, months):
    month = day.month - 1 + months
    year, month = day.year + month // 12, month % 12 + 1
    last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)).day
    return dt.date(year, month, min(day.day, last))


def expected_period(day, t0, months=3):
    bound, number = add_months(t0, months) - dt.timedelta(1), 1
    while day > bound:
        bound, number = add_months(bound, months), number + 1
    return number


@pytest.mark.parametrize(
    "t0", ["2019-01-01", "2019-11-30", "2019-01-31", "2020-02-29", "2019-08-31", "2018-12-01", "2019-05-30"]
)
def test_period_number_follows_the_drifting_bounds(spark, t0):
    start = dt.date.fromisoformat(t0)
    days = [start + dt.timedelta(i) for i in range(0, 3500)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    sizes = (3, 1, 2, 4, 5, 6, 12)
    columns = [D.period_number(F.col("d"), F.lit(start), m).alias(f"m{m}") for m in sizes]
    for row in df.select("d", *columns).collect():
        assert [row[f"m{m}"] for m in sizes] == [expected_period(row.d, start, m) for m in sizes]


def test_bound_drift_example(spark):
    """From Jan 1 the fourth bound is Dec 30, so Dec 31 opens the fifth period."""
    assert expected_period(dt.date(2019, 12, 30), dt.date(2019, 1, 1)) == 4
    assert expected_period(dt.date(2019, 12, 31), dt.date(2019, 1, 1)) == 5


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [r[0] for r in df.select(V.cosine("a", "b")).collect()] == [1.0, -1.0, 0.0]


@settings(max_examples=5, deadline=None)
@given(seed=st.integers(0, 10**6), dim=st.integers(1, 20))
def test_cosine_with_equals_the_expression(spark, seed, dim):
    rng = np.random.default_rng(seed)
    fixed = rng.normal(size=(3, dim)).round(3)
    rows = [(i, [float(x) for x in rng.normal(size=dim).round(3)]) for i in range(20)]
    df = spark.createDataFrame([*rows, (20, None), (21, [0.0] * dim)], "i int, v array<double>")
    fast = V.cosine_with(fixed)(F.col("v"))
    slow = F.array(*[V.cosine(F.col("v"), F.lit(list(map(float, c)))) for c in fixed])
    for r in df.select("i", fast.alias("fast"), slow.alias("slow")).collect():
        if r.i == 20:
            assert r.fast is None
        else:
            assert np.allclose(r.fast, r.slow, atol=1e-12)


def test_cosine_with_refuses_other_widths(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    with pytest.raises(Exception, match="must have 2 values"):
        df.select(V.cosine_with([[1, 0]])(F.col("v"))).collect()


def test_softmax_and_class(spark, values):
    p = values(V.softmax, [[0.0, 0.0], [1000.0, 0.0], [1.0, 3.0]], "array<double>")
    assert p[0] == [0.5, 0.5] and p[1] == [1.0, 0.0] and abs(sum(p[2]) - 1) < 1e-12
    df = spark.createDataFrame([(0.5, 0.5), (0.49, 0.51), (0.6, 0.4)], "a double, b double")
    assert [r[0] for r in df.select(V.class_of(F.col("a"), F.col("b"))).collect()] == [0, 1, 0]
