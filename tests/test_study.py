"""The whole study on messages made of the small events and documents."""

import pytest
from pyspark.sql import functions as F

from kohorta.plans import inputs as I
from kohorta.plans.study import Study
from kohorta.sources import tables


@pytest.fixture(scope="module")
def study(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("study")
    words = F.array(*[F.lit(w) for w in (
        "my diabetes and insulin and more", "anxiety and burnout again", "asthma and cancer again",
        "a plain line without any of it",
    )])
    day = F.datediff("ts", F.lit("2024-01-01").cast("date")) * 30
    when = F.timestamp_seconds(F.unix_timestamp(F.lit("2019-01-01 10:00:00")) + day * 86400)
    k = F.col("event_id")
    messages = I.table(spark, small, "events").select(
        F.to_json(
            F.struct(
                k.alias("id"),
                F.concat(F.lit("Mon "), F.date_format(when, "MMM dd HH:mm:ss"), F.lit(" +0000 "),
                         F.year(when).cast("string")).alias("created_at"),
                F.concat(F.lit("@you I can't believe it, "), F.element_at(words, (k * k % 11 % 4 + 1).cast("int")),
                         F.lit(" what a day number "), (k % 7).cast("string"),
                         F.lit(" https://t.co/x")).alias("text"),
                F.lit("en").alias("lang"),
                F.struct(F.col("user_id").alias("id")).alias("user"),
            )
        ).alias("value")
    )
    messages.write.text(str(folder / "messages"))
    return Study(spark, str(folder / "store"))


def test_study(study, spark):
    source = study.folder.rsplit("/", 1)[0] + "/messages"
    study.ingest(source).awaitTermination()
    posts = study.table("posts")
    assert 0 < posts.count() < 1000  # only posts with a track keyword

    personal = F.col("text").rlike("number [0-3]").cast("int").alias("label")
    metrics = study.train(posts.select("id", "text", personal), features=1 << 12).first()
    assert metrics.tp + metrics.fp + metrics.fn + metrics.tn > 0 and metrics.accuracy == 1.0

    everyone = tables.read_messages(spark, source)
    authors = study.select_authors(everyone.select("user_id").filter("user_id <> 3"))
    assert 0 < authors.count() <= 14
    assert authors.filter("user_id = 3").count() == 0

    timelines = study.collect_timelines(everyone, 60)
    assert timelines.groupBy("user_id").count().filter("count > 60").count() == 0
    prepared = study.prepare()
    assert prepared.filter("prep like '%http%' or prep like '%@%' or prep like '%can''t%'").count() == 0

    summary = study.compare_encoders({"tfidf": None}, n=100)
    assert summary.count() == 20 and summary.filter("n <> 100").count() == 0
    assert study.screen_thresholds(n=200, k=5).groupBy("concept").count().filter("count > 5").count() == 0

    scores = study.score()
    assert scores.count() == prepared.count() and "Mental health" in scores.columns
    entered = study.enter()
    first = F.min_by(F.struct("keyword", "Diabetes"), F.struct("created_ts", "id")).alias("first")
    entries = entered.groupBy("user_id").agg(first)
    assert 0 < entered.count() <= scores.count()
    assert entries.filter("not first.keyword and first.Diabetes < 0.33").count() == 0

    periods = study.build_cohort("Comorbidities", "Mental health", min_posts=10)
    assert periods.count() > 0
    csv = tables.read_periods(spark, study.path("cohort_periods_csv"))
    assert sorted(csv.collect()) == sorted(periods.select(*csv.columns).collect())
    intervals = study.intervals()
    assert intervals.filter("start > stop").count() == 0


def test_scratch_tables_go_with_their_scope(spark):
    from pathlib import Path

    from kohorta.session import cut_lineage, scratch_scope

    outer = cut_lineage(spark.range(3))
    with scratch_scope(spark):
        inner = cut_lineage(spark.range(5))
        assert inner.count() == 5
        path = Path(inner.inputFiles()[0].removeprefix("file:")).parent
    assert not path.exists() and outer.count() == 3
