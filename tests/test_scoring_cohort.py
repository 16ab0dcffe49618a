import datetime as dt
import statistics

import numpy as np
import pytest
from conftest import executed_plan
from pyspark.sql import functions as F

from kohorta.operators import cohort as H
from kohorta.operators import scoring as S

VECTORS = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [1.0, 1.0], 4: [0.0, 0.0]}


@pytest.fixture
def posts(spark):
    return spark.createDataFrame(list(VECTORS.items()), "id int, vector array<float>")


@pytest.fixture
def concepts(spark):
    rows = [("b", [0.0, 2.0]), ("a", [3.0, 0.0])]
    return spark.createDataFrame(rows, "concept string, vector array<float>")


def test_score_concepts_and_pivot(posts, concepts):
    long = S.score_concepts(posts, concepts)
    found = {(r.id, r.concept): r.similarity for r in long.collect()}
    assert found == {
        (1, "a"): 1.0, (1, "b"): 0.0, (2, "a"): 0.0, (2, "b"): 1.0,
        (3, "a"): 0.707107, (3, "b"): 0.707107, (4, "a"): 0.0, (4, "b"): 0.0,
    }
    wide = S.score_wide(posts, concepts).orderBy("id").collect()
    assert wide == S.pivot_scores(long, ["a", "b"], ["id"]).orderBy("id").collect()


def test_scoring_needs_no_shuffle(posts, concepts):
    plan = executed_plan(S.score_concepts(posts, concepts))
    assert "Exchange" not in plan and "Join" not in plan


def test_posts_without_a_vector(spark, concepts):
    df = spark.createDataFrame([(1, None)], "id int, vector array<float>")
    assert S.score_wide(df, concepts).first()["a"] is None
    assert S.score_concepts(df, concepts).count() == 0


def test_concept_checks(spark, concepts, monkeypatch):
    with pytest.raises(ValueError, match="unique"):
        S.concept_vectors(concepts.union(concepts))


def test_slices_give_the_same_scores(posts, concepts, monkeypatch):
    key = lambda df: sorted(map(str, df.collect()))
    long, wide = key(S.score_concepts(posts, concepts)), key(S.score_wide(posts, concepts))
    monkeypatch.setattr(S, "SLICE_VALUES", 1)
    assert len(S.concept_slices(S.concept_vectors(concepts))) == 2
    assert key(S.score_concepts(posts, concepts)) == long
    assert key(S.score_wide(posts, concepts)) == wide


def test_thresholds_both_ways(spark, posts, concepts, monkeypatch):
    scores = S.score_concepts(posts, concepts)
    limits = spark.createDataFrame([("a", 0.707107), ("b", 0.9)], "concept string, threshold double")
    for bound in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
        out = S.apply_thresholds(scores, limits).collect()
        assert sorted((r.id, r.concept) for r in out) == [(1, "a"), (2, "b"), (3, "a")]


def test_top_k_has_at_most_k_and_breaks_ties_by_id(posts, concepts):
    scores = S.score_concepts(posts, concepts)
    top = S.top_k_per_concept(scores, 3).filter("concept = 'a'").orderBy("rank").collect()
    assert [(r["rank"], r.id) for r in top] == [(1, 1), (2, 3), (3, 2)]
    assert S.top_k_per_concept(scores, 500).count() == 8


def test_encoder_summary_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [
        (e, c, float(v))
        for e, c, n in (("x", "a", 101), ("x", "b", 100), ("y", "a", 1), ("y", "b", 2))
        for v in rng.choice(np.round(rng.uniform(-1, 1, 30), 6), n)
    ]
    df = spark.createDataFrame(rows, "encoder string, concept string, similarity double")
    for r in S.encoder_summary(df).collect():
        own = [v for e, c, v in rows if (e, c) == (r.encoder, r.concept)]
        assert (r.n, r.min_similarity, r.max_similarity) == (len(own), min(own), max(own))
        assert r.median_similarity == pytest.approx(statistics.median(own), abs=1e-12)


LIMITS = {"e": 0.5, "o": 0.5}
DAY = dt.date(2019, 1, 1)


def scored(spark, rows):
    """rows: user, day offset, exposure, outcome"""
    data = [(u, i, DAY + dt.timedelta(d), e, o) for i, (u, d, e, o) in enumerate(rows)]
    return spark.createDataFrame(
        data, "user_id int, id int, normalised_date date, e double, o double"
    )


def cohort(spark, rows, **options):
    options = {"min_posts": 0, **options}
    out = H.build_cohort(scored(spark, rows), "e", "o", LIMITS, **options)
    return sorted(
        (r.user_id, r.quarter, (r.d_t0 - DAY).days, (r.date_tn - DAY).days, r.exposition, r.outcome)
        for r in out.collect()
    )


def test_cohort_rows(spark):
    rows = [
        (1, 0, 0.9, 0.0), (1, 10, 0.0, 0.0),  # first period, exposed
        (1, 200, 0.0, 0.0),  # third period; the second is empty
        (1, 300, 0.0, 0.5), (1, 300, 0.9, 0.0),  # outcome day, all kept
        (1, 301, 0.9, 0.0), (1, 900, 0.9, 0.9),  # afterwards
        (2, 5, None, None), (2, 6, 0.4, 0.4),
    ]
    expected = [
        (1, 1, 0, 10, 1, 0), (1, 3, 200, 200, 0, 0), (1, 4, 300, 300, 1, 1), (2, 1, 5, 6, 0, 0),
    ]
    assert cohort(spark, rows) == expected
    by_user = [(*r[:5], 1 if r[0] == 1 else 0) for r in expected]
    assert cohort(spark, rows, outcome_scope="user") == by_user
    with pytest.raises(ValueError):
        cohort(spark, rows, outcome_scope="post")


def test_cohort_size_is_strict(spark):
    rows = [(1, d, 0.0, 0.0) for d in range(100)] + [(2, d, 0.0, 0.0) for d in range(101)]
    assert {r[0] for r in cohort(spark, rows, min_posts=100)} == {2}


def test_cohort_deduplicates_after_the_size_test(spark):
    first = scored(spark, [(1, 0, 0.0, 0.0), (1, 5, 0.0, 0.0)])
    copy = first.withColumns(
        {"normalised_date": F.date_add("normalised_date", 400), "e": F.lit(1.0)}
    )
    out = H.build_cohort(
        first.unionByName(copy), "e", "o", LIMITS, min_posts=3, deduplicate=True
    ).collect()
    assert [(r.quarter, r.exposition) for r in out] == [(1, 0)]


def test_a_hot_user_is_rolled_up_before_the_shuffle(spark):
    posts = spark.range(200_000, numPartitions=8).select(
        F.when(F.col("id") < 0, 2).otherwise(1).alias("user_id"), "id",
        F.date_add(F.lit(DAY), (F.col("id") % 50).cast("int")).alias("normalised_date"),
        F.lit(0.0).alias("e"), F.lit(0.0).alias("o"),
    )
    out = H.build_cohort(posts, "e", "o", LIMITS, 100)
    plan = executed_plan(out)
    exchange = plan.index("Exchange hashpartitioning(user_id")
    assert "partial_max" in plan[exchange:] and plan.count("Exchange hashpartitioning") == 2


def test_intervals(spark):
    day = lambda d: DAY + dt.timedelta(d)
    rows = [
        (1, 1, day(0), day(0), 0, 0), (1, 2, day(100), day(110), 1, 0),
        (1, 4, day(300), day(300), 0, 0), (1, 5, day(400), day(405), 1, 1), (1, 6, day(500), day(520), 1, 1),
        (2, 1, day(0), day(0), 0, 1), (3, 1, day(0), day(30), 0, 0),
    ]
    periods = spark.createDataFrame(
        rows, "user_id int, quarter int, d_t0 date, date_tn date, exposition int, outcome int"
    )
    out = sorted(
        (r.user_id, r.quarter, r.start, r.stop, r.exposition, r.outcome)
        for r in H.to_intervals(periods).collect()
    )
    assert out == [
        (1, 2, 0, 10, 1, 0), (1, 4, 10, 10, 0, 0), (1, 5, 10, 15, 1, 1), (3, 1, 0, 30, 0, 0),
    ]


def test_interval_lengths_add_up(spark, small):
    from kohorta.plans import catalog

    periods = catalog._cohort(spark, small).withColumn("outcome", F.lit(0))
    spans = periods.groupBy("user_id").agg(F.sum(F.datediff("date_tn", "d_t0")).alias("days"))
    last = H.to_intervals(periods).groupBy("user_id").agg(F.max("stop").alias("stop"))
    assert spans.filter("days > 0").count() == last.count() > 0
    assert spans.join(last, "user_id").filter("days <> stop").count() == 0
