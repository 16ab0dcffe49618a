import datetime as dt
import random

import pyarrow.parquet as pq
import pytest
from conftest import executed_plan
from pyspark.sql import functions as F

from kohorta import session
from kohorta.operators import posts as P
from kohorta.operators import timeline as L
from kohorta.operators.skew import salted_join, top_n
from kohorta.plans import catalog


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_full_text_takes_the_longest_known_form(spark):
    schema = "id int, text string, full_text string, extended_tweet struct<full_text: string>"
    rows = [(1, "t", None, None), (2, "t", "f", None), (3, "t", "f", ("e",)), (4, None, None, None)]
    df = P.with_full_text(spark.createDataFrame(rows, schema)).orderBy("id")
    assert [r.text for r in df.collect()] == ["t", "f", "e", None]
    bare = spark.createDataFrame([(1, "t")], "id int, text string")
    assert P.with_full_text(bare).first().text == "t"


def test_clean_text_rules(spark):
    eight = "one two three four five six seven eight"
    rows = [
        (1, eight), (1, "zz " + eight), (2, "one two three four five six seven"),
        (3, "RT @x " + eight), (4, "RT x " + eight), (5, " RT @x " + eight), (6, None),
        (7, "https://t.co/a " + eight), (8, eight + " https://t.co/a"), (9, "@a " + eight),
        (10, "@a one two three four five six seven"), (11, "a\tb  c d\ne f g h"),
    ]
    out = L.clean_text(spark.createDataFrame(rows, "id int, text string"))
    assert {r.id: r.prep for r in out.collect()} == {
        1: eight, 4: "RT x " + eight, 5: " RT  " + eight, 8: eight + " ", 9: " " + eight,
        11: "a\tb  c d\ne f g h",
    }


def test_clean_text_gives_flags_in_place_of_texts(spark):
    eight = "one two three four five six seven eight"
    rows = [(1, 2, eight + " can't"), (1, 1, eight), (2, 1, "@a don't " + eight), (3, 1, "short"), (3, 2, eight), (4, 1, None),
            (5, 1, "RT @x " + eight), (None, 1, eight), (6, None, eight), (6, 5, eight + " cannot")]
    posts = spark.createDataFrame(rows, "id int, seq int, text string").repartition(3)
    hit = F.col("prep").contains("not")
    want = L.clean_text(posts, [F.col("seq")], expand=True).select("id", "seq", hit.alias("hit"))
    got = L.clean_text(posts, [F.col("seq")], expand=True, flags={"hit": hit})
    assert got.columns == ["id", "seq", "hit"]
    order = lambda r: str(tuple(r))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(map(tuple, want.collect()), key=order)
    assert {r.id: r.hit for r in got.collect()} == {1: False, 2: True, None: False, 6: False}


def test_no_text_of_a_whole_chain_travels_to_meet_its_copies(spark, small, monkeypatch):
    plans, cut = {}, catalog.cut_lineage
    monkeypatch.setattr(catalog, "cut_lineage", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), cut(df, name))[1])
    catalog.timeline_to_intervals(spark, small).count()
    above, found, _ = plans["clean"].partition("Exchange hashpartitioning(id#")
    assert found and "prep#" not in above


def test_dedup_keeps_the_first_and_is_idempotent(spark):
    rows = [(1, 3, "c"), (1, 1, "a"), (2, 5, "x"), (1, 1, "b")]
    df = spark.createDataFrame(rows, "id int, seq int, text string")
    order = [F.col("seq"), F.col("text")]
    once = P.dedup_posts(df, order)
    assert sorted(map(tuple, once.collect())) == [(1, 1, "a"), (2, 5, "x")]
    assert sorted(once.collect()) == sorted(P.dedup_posts(once, order).collect())


def test_large_rows_are_stored_in_small_groups(spark):
    rows = spark.range(0, 40, 1, 1).select("id", F.repeat(F.md5(F.col("id").cast("string")), 1 << 15).alias("text"))
    kept = session.cut_lineage(rows, "large", **{**session.LARGE_ROWS, "compression": "none"})
    groups = [pq.read_metadata(f.removeprefix("file://")) for f in kept.inputFiles()]
    assert max(g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups)) < 40
    assert sorted(kept.collect()) == sorted(rows.collect())


def test_dedup_drops_copies_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("id"), F.col("id").alias("seq"))
    plan = executed_plan(P.dedup_posts(df, [F.col("seq")]))
    assert "row_number(), 1, Partial" in plan


@pytest.mark.parametrize("n", [1, 5, 40, 5000])
def test_top_n_equals_a_plain_sort(spark, n):
    rng = random.Random(n)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(5), rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, v int, i int").repartition(7)
    out = {}
    for r in top_n(df, ["k"], [F.col("v").desc(), F.col("i")], n).collect():
        out.setdefault(r.k, []).append((r["rank"], r.i))
    for k in range(5):
        best = sorted((-v, i) for kk, v, i in rows if kk == k)[:n]
        assert sorted(out[k]) == [(j + 1, i) for j, (_, i) in enumerate(best)]


def test_top_n_cuts_before_both_shuffles(spark):
    df = spark.range(50_000).select(F.col("id"), (F.col("id") % 3).alias("k"))
    plan = executed_plan(top_n(df, ["k"], [F.col("id")], 9_000))
    assert plan.count("9000, Partial") == 2


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_the_plain_join(spark, how):
    rows = spark.range(400).select((F.col("id") % 9).alias("k"), "id").repartition(13)
    facts = spark.createDataFrame([(k, k * 10) for k in range(0, 20, 2)], "k bigint, f int")
    plain = sorted(map(tuple, rows.join(facts, "k", how).collect()), key=str)
    assert sorted(map(tuple, salted_join(rows, facts, "k", how).collect()), key=str) == plain


def test_latest_per_user(spark):
    rows = [(1, i, f"p{i}") for i in range(50)] + [(2, 100, "a"), (2, 101, "b")] + [(1, 49, "copy")]
    df = spark.createDataFrame(rows, "user_id int, id int, text string").repartition(5)
    out = L.latest_per_user(df, 3)
    assert sorted((r.user_id, r.id) for r in out.collect()) == [
        (1, 47), (1, 48), (1, 49), (1, 49), (2, 100), (2, 101),
    ]
    assert ids(L.latest_per_user(df, 100)) == sorted(r[1] for r in rows)


def test_build_timelines_counts_reposts_before_dropping_them(spark):
    rows = [(1, 1, "old"), (1, 2, "RT @x"), (1, 3, "new"), (2, 9, "other")]
    posts = spark.createDataFrame(rows, "user_id int, id int, text string")
    users = spark.createDataFrame([(1,)], "user_id int")
    assert ids(L.build_timelines(posts, users, 2)) == [3]


def test_build_timelines_fetches_texts_of_the_latest_posts_alone(spark):
    """Texts kept apart: absent ones do not count, repeated ones repeat, and none is stored."""
    rows = [(1, 1, 10), (1, 2, 11), (1, 3, 12), (1, 4, 99), (1, 5, None), (2, 9, 10)]
    posts = spark.createDataFrame(rows, "user_id int, id int, text_id int")
    texts = spark.createDataFrame([(10, "old"), (11, "twice"), (11, "twice"), (12, "RT @x")], "text_id int, text string")
    users = spark.createDataFrame([(1,)], "user_id int")
    first = len(session._scratch)
    out = L.build_timelines(posts, users, 2, texts)
    assert sorted(map(tuple, out.collect())) == sorted(
        map(tuple, L.build_timelines(posts.join(texts, "text_id").drop("text_id"), users, 2).collect())
    ) == [(1, 2, "twice"), (1, 2, "twice")]
    assert "text" not in spark.read.parquet(session._scratch[first]).columns


def test_semi_and_anti_joins(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    known = spark.createDataFrame([(2,), (2,), (3,)], "user_id int")
    assert ids(P.keep_existing(users, known), "user_id") == [2]
    store = spark.createDataFrame([(1, "old")], "id int, text string")
    incoming = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "id int, text string")
    out = P.append_new(incoming, store, [F.col("text")])
    assert sorted(map(tuple, out.collect())) == [(1, "old"), (2, "a")]


def test_min_timeline_is_strict(spark):
    rows = [(1, i) for i in range(100)] + [(2, i) for i in range(101)]
    df = spark.createDataFrame(rows, "user_id int, id int")
    out = L.min_timeline(df)
    assert out.count() == 101 and out.select("user_id").distinct().first()[0] == 2


def test_translations(spark):
    rows = [(1, "en", "a"), (2, "fr", "b"), (3, "fr", "c"), (4, None, "d")]
    posts = spark.createDataFrame(rows, "id int, lang string, text string")
    table = spark.createDataFrame([(1, "X"), (2, "B"), (4, "D")], "id int, text_en string")
    out = {r.id: r.text for r in P.apply_translations(posts, table).collect()}
    assert out == {1: "a", 2: "B", 3: "c", 4: "D"}


def test_sample_head(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")).repartition(9)
    assert [r.id for r in P.sample_head(df, 5).collect()] == [0, 1, 2, 3, 4]
    assert P.sample_head(df, 5000).count() == 1000
    assert P.sample_head(df.filter("id < 0"), 5).count() == 0


def timeline(spark, rows):
    """rows: user, id, time offset in hours, similarity, text"""
    start = dt.datetime(2020, 1, 1)
    data = [
        (u, i, start + dt.timedelta(hours=h), (start + dt.timedelta(hours=h)).date(), s, t)
        for u, i, h, s, t in rows
    ]
    return spark.createDataFrame(
        data,
        "user_id int, id int, created_ts timestamp, normalised_date date, similarity double, prep string",
    )


def test_define_t0(spark):
    rows = [
        (1, 1, 0, 0.1, "x"), (1, 2, 1, 0.1, "a t1d"), (1, 3, 2, 0.9, "x"),  # keyword first
        (2, 4, 0, 0.1, "x"), (2, 5, 1, 0.33, "x"), (2, 6, 2, 0.0, "t1d"),  # similarity first
        (3, 7, 0, 0.1, "x"), (3, 8, 1, 0.9, "t1d"),  # the same row
        (4, 9, 0, None, "x"), (4, 10, 1, 0.32, "T1D"), (4, 11, 2, 0.1, None),  # never
        (5, 13, 0, 0.1, "x"), (5, 12, 0, 0.1, "x"), (5, 14, 0, 0.5, "x"),  # one instant, by id
    ]
    out = L.define_t0(timeline(spark, rows), L.entry_hit(0.33, ["t1d"]))
    assert ids(out) == [2, 3, 5, 6, 8, 14]


def test_truncate_keeps_the_whole_outcome_day(spark):
    rows = [(1, 1, 0, 0.1, ""), (1, 2, 30, 0.9, ""), (1, 3, 47, 0.1, ""), (1, 4, 48, 0.9, ""),
            (2, 5, 0, None, ""), (2, 6, 99, 0.1, "")]
    out = L.truncate_at_outcome(timeline(spark, rows), F.col("similarity") >= 0.5)
    assert ids(out) == [1, 2, 3, 5, 6]


def test_positions(spark):
    rows = [(u, 1000 - i, i * 5 % 77, 0.0, "") for i in range(100) for u in (1, 2)]
    out = L.timeline_positions(timeline(spark, rows)).collect()
    for user in (1, 2):
        mine = sorted((r.created_ts, r.id, r.position) for r in out if r.user_id == user)
        assert [p for _, _, p in mine] == list(range(100))


def test_assign_periods_skips_empty_ones_but_counts_them(spark):
    rows = [(1, 1, 0, 0.0, ""), (1, 2, 24 * 90, 0.0, ""), (1, 3, 24 * 91, 0.0, ""), (1, 4, 24 * 300, 0.0, "")]
    out = L.assign_periods(timeline(spark, rows))
    assert sorted((r.id, r.quarter) for r in out.collect()) == [(1, 1), (2, 1), (3, 2), (4, 4)]


def test_a_hot_user_is_split_at_run_time(spark):
    """A user with most of the posts does not end up in one join task."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        posts = spark.range(60_000, numPartitions=16).select(
            F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 500).alias("user_id"),
            "id",
            F.timestamp_seconds("id").alias("created_ts"),
            F.to_date(F.timestamp_seconds("id")).alias("normalised_date"),
            (F.col("id") % 100 / 100).alias("similarity"),
        )
        out = L.define_t0(posts, F.col("similarity") >= 0.5)
        plan = executed_plan(out)
        assert "isSkew=true" in plan or "skew=true" in plan
        assert out.count() == posts.join(
            posts.filter("similarity >= 0.5").groupBy("user_id").agg(F.min("id").alias("m")), "user_id"
        ).filter("id >= m").count()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
