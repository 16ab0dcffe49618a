import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kohorta.operators import classify as C
from kohorta.operators import embedding as E
from kohorta.operators import scoring as S
from kohorta.session import scratch_path, shared_folder
from kohorta.sources import settings, tables
from kohorta.streaming import ingest as G

TEXTS = [
    (i, ("I take my insulin every day" if i % 2 else "new study on the sugar market") + f" n{i}", i % 2)
    for i in range(60)
]


@pytest.fixture(scope="module")
def examples(spark):
    return spark.createDataFrame(TEXTS, "id int, text string, label int")


def test_split_is_disjoint_and_stable(spark):
    df = spark.range(5000)
    parts = C.split_examples(df)
    share = {r.part: r["count"] / 5000 for r in parts.groupBy("part").count().collect()}
    assert share["test"] == pytest.approx(0.33, abs=0.03)
    assert share["validation"] == pytest.approx(0.67 * 0.2, abs=0.03)
    again = C.split_examples(df.repartition(7))
    assert parts.exceptAll(again).count() == 0


def _regularised_loss(model, rows, step, at):
    """Training loss in NumPy with ``step`` added to weight ``at``; -1 is the bias."""
    y, x = np.array([r.label for r in rows]), np.array([r.features.toArray() for r in rows])
    w, bias = model.stages[-1].coefficients.toArray().copy(), model.stages[-1].intercept
    if at < 0:
        bias += step
    else:
        w[at] += step
    z = x @ w + bias
    spread = x.var(axis=0, ddof=1)
    return np.mean(np.logaddexp(0, z) - y * z) + model.stages[-1].getRegParam() / 2 * np.sum(spread * w**2)


def test_gradient_is_zero_where_training_ends(spark, examples):
    model = C.train_classifier(examples, features=1 << 8)
    assert np.abs(C.loss_gradient(model, examples)).max() < 1e-5
    other = examples.filter("id < 45").withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    gradient = C.loss_gradient(model, other)
    rows = model.transform(C.with_normal_text(other)).collect()
    assert np.abs(gradient).max() > 1e-2
    for at in (-1, *np.argsort(-np.abs(gradient[:-1]))[:3].tolist(), 0):
        slope = (_regularised_loss(model, rows, 1e-5, at) - _regularised_loss(model, rows, -1e-5, at)) / 2e-5
        assert gradient[at] == pytest.approx(slope, abs=1e-6)


def test_gradient_without_a_class_or_rows(spark, examples):
    model = C.train_classifier(examples, features=1 << 8)
    assert not C.loss_gradient(model, examples.limit(0)).any()
    only = C.loss_gradient(model, examples.filter("label = 0"))
    assert np.isfinite(only).all() and only[-1] > 0


def test_train_save_load_classify(spark, examples):
    model = C.train_classifier(examples, features=1 << 12)
    path = scratch_path(spark, "model")
    C.save_classifier(model, path)
    posts = examples.select("id", "text", F.struct(F.col("id").alias("id")).alias("user"))
    out = C.classify(posts, C.load_classifier(path))
    assert {r.id: r.personal for r in out.collect()} == {i: y for i, _, y in TEXTS}
    assert out.filter("abs(p0 + p1 - 1) > 1e-9").count() == 0
    assert sorted(r.user_id for r in C.select_authors(out).collect()) == list(range(1, 60, 2))
    metrics = C.evaluate(model, examples).first()
    assert (metrics.accuracy, metrics.f1, metrics.tp) == (1.0, 1.0, 30)


def test_metrics_are_zero_where_undefined(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, predicted int")
    row = C.binary_metrics(df).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.5, 0.0, 0.0, 0.0)


def test_tfidf_equals_brute_force(spark):
    texts = [(1, "sugar sugar tea"), (2, "tea milk"), (3, "milk milk milk"), (4, "")]
    df = spark.createDataFrame(texts, "id int, prep string")
    out = E.embed(df, E.fit_tfidf(df, features=4096))
    vectors = {r.id: np.array(r.vector) for r in out.collect()}
    counts = {i: {w: t.split().count(w) for w in set(t.split())} for i, t in texts}
    seen = {w: sum(w in c for c in counts.values()) for c in counts.values() for w in c}
    weight = {w: np.log(5 / (n + 1)) for w, n in seen.items()}
    for a in (1, 2, 3):
        assert np.linalg.norm(vectors[a]) == pytest.approx(1, abs=1e-6)
        for b in (1, 2, 3):
            dot = sum(counts[a][w] * counts[b].get(w, 0) * weight[w] ** 2 for w in counts[a])
            norm = [np.sqrt(sum((k * weight[w]) ** 2 for w, k in counts[i].items())) for i in (a, b)]
            assert vectors[a] @ vectors[b] == pytest.approx(dot / norm[0] / norm[1], abs=1e-6)
    assert not vectors[4].any()


def test_own_network_and_stored_vectors(spark):
    def make():
        def predict(texts):
            return np.array([[len(t), t.count("a"), 1.0] for t in texts], dtype="f4")

        return predict

    df = spark.createDataFrame([(1, "banana"), (2, "kiwi")], "id int, prep string")
    out = E.embed(df, E.network_encoder(make, batch_size=1))
    assert {r.id: list(r.vector) for r in out.collect()} == {1: [6.0, 3.0, 1.0], 2: [4.0, 0.0, 1.0]}
    assert E.embed(out, "vector", into="v").first().v == out.first().vector


def test_concepts_are_scored_by_their_keywords(spark):
    texts = [(1, "anxiety and distress again"), (2, "a new pump and strips"), (3, "nothing")]
    df = spark.createDataFrame(texts, "id int, prep string")
    concepts = settings.load_concepts(spark)
    encoder = E.fit_tfidf(df)
    scores = E.score_texts(df, encoder, concepts)
    small = E.fit_tfidf(df, features=512)
    dense = S.score_concepts(E.embed(df, small).drop("prep"), E.embed_concepts(concepts, small))
    sparse = E.score_texts(df, small, concepts)
    gap = dense.join(sparse.withColumnRenamed("similarity", "other"), ["id", "concept"])
    assert gap.count() == 60 and gap.filter("abs(similarity - other) > 2e-6").count() == 0
    best = {r.id: r.concept for r in S.top_k_per_concept(scores.filter("similarity > 0"), 1).collect()}
    assert best[1] == "Mental health" and best[2] == "Diabetes devices and supply"


def test_settings(spark, tmp_path):
    concepts = {r.concept: r.keywords for r in settings.load_concepts(spark).collect()}
    assert len(concepts) == 20 and concepts["Food"] == ["food", "nutrition", "diet"]
    limits = {r.concept: r.threshold for r in settings.load_thresholds(spark).collect()}
    assert set(limits) == set(concepts) and limits["Affordability"] == 0.53
    assert len(settings.load_track(spark)) == 15
    own = tmp_path / "own.json"
    own.write_text(json.dumps({"concept_keywords": {"A": "x, y"}, "thresholds": {"A": 0.1}, "track": ["q"]}))
    assert settings.load_concepts(spark, str(own)).first().keywords == ["x", "y"]
    assert settings.load_track(spark, str(own)) == ["q"]


def test_labelled_csv_with_awkward_text(spark, tmp_path):
    texts = ['say "hi", ok', "two\nlines", "plain", "back\\slash"]
    path = str(tmp_path / "labelled")
    spark.createDataFrame([(t, 1) for t in texts], "text string, labels int").write.csv(
        path, header=True, escape='"'
    )
    out = tables.read_labelled(spark, path)
    assert out.columns == ["text", "label"]
    assert sorted(r.text for r in out.collect()) == sorted(texts)


def test_predicates_reach_the_reader(spark, small):
    from kohorta.plans import catalog

    out = catalog.registered()["predicate_scan"](spark, small)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in plan and "props" not in plan


def message(i, text="tea", created="Wed Aug 27 13:08:45 +0000 2008", **more):
    return json.dumps(
        {"id": i, "created_at": created, "text": text, "lang": "en", "user": {"id": i % 3}, **more}
    )


LINES = [
    message(1), message(2), message(2), '{"id": 3, "te', message(4, created="yesterday"),
    json.dumps({"text": "no id"}), message(5, text="COFFEE", extra={"a": 1}), "", "[]",
]


def test_messages(spark, tmp_path):
    (tmp_path / "m.json").write_text("\n".join(LINES))
    posts = tables.read_messages(spark, str(tmp_path))
    assert sorted(r.id for r in posts.collect()) == [1, 2, 2, 5]
    times = posts.select(F.date_format("created_ts", "yyyy-MM-dd HH:mm:ss").alias("t")).distinct()
    assert [r.t for r in times.collect()] == ["2008-08-27 13:08:45"]
    assert {r.user_id for r in posts.filter("id = 5").collect()} == {2}


@pytest.mark.parametrize("options", [{"block": 2}, {}, {"horizon": "1 day"}])
def test_streams_store_each_post_once(spark, tmp_path, options):
    source, store, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(LINES))

    def run():
        stream = G.read_posts_stream(spark, source, max_files=1)
        query = G.start_ingest(stream, store, progress, available_now=True, **options)
        query.awaitTermination()
        return sorted(r.id for r in spark.read.parquet(store).collect())

    assert run() == [1, 2, 5]
    (tmp_path / "in" / "b.json").write_text("\n".join([*LINES, message(6), message(6)]))
    assert run() == [1, 2, 5, 6]
    (tmp_path / "in" / "c.json").write_text("\n".join(LINES))
    assert run() == [1, 2, 5, 6]


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    (tmp_path / "m.json").write_text("\n".join(LINES))
    batch = tables.read_messages(spark, str(tmp_path / "m.json"))
    for _ in range(2):
        G.insert_unseen(batch, path, block=2)
        assert spark.read.parquet(path).count() == 3


def test_stream_equals_batch_and_tracks_keywords(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.json").write_text("\n".join(LINES))
    stream = G.read_posts_stream(spark, str(tmp_path / "in"), ["coffee"])
    query = G.start_ingest(
        stream, str(tmp_path / "out"), str(tmp_path / "progress"), available_now=True
    )
    query.awaitTermination()
    counts = [p["observedMetrics"]["ingest"] for p in query.recentProgress if "ingest" in p["observedMetrics"]]
    assert any(c["messages"] == 9 and c["dropped"] == 5 for c in counts)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [5]


def test_shared_folder_is_the_sessions_own(spark):
    folder = shared_folder(spark)
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_folder(spark) == folder == given.rstrip("/")
    assert scratch_path(spark, "x").startswith(folder + "/x-")


def test_few_files_per_block_and_compaction(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        path, target = str(tmp_path / "store"), str(tmp_path / "compact")
        for start in (0, 400):
            rows = [(i, "2020-01-01 00:00:00") for i in range(start, start + 400)]
            batch = spark.createDataFrame(rows, "id long, t string").selectExpr("id", "timestamp(t) AS created_ts")
            G.insert_unseen(batch.repartition(16), path, block=100)
        files = list((tmp_path / "store").glob("id_block=*/*.parquet"))
        assert len(files) <= 8 * G.BLOCK_PARTS and spark.read.parquet(path).count() == 800
        G.compact(spark, path, target)
        assert spark.read.parquet(target).count() == 800
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_keywords_in_any_text_form_and_late_posts(spark, tmp_path):
    import json

    (tmp_path / "in").mkdir()
    base = {"created_at": "Mon Jan 05 10:00:00 +0000 2015", "lang": "en", "user": {"id": 1}}
    posts = [
        {"id": 1, "text": "coffee"}, {"id": 2, "text": "cut", "extended_tweet": {"full_text": "more coffee"}},
        {"id": 3, "full_text": "Coffee"}, {"id": 4, "text": "tea"},
    ]
    ahead = {**base, "id": 9, "text": "coffee", "created_at": "Mon Jan 06 10:00:00 +0000 2098"}
    (tmp_path / "in" / "a.json").write_text(json.dumps(ahead))

    def run():
        stream = G.read_posts_stream(spark, str(tmp_path / "in"), ["coffee"], max_files=1)
        query = G.start_ingest(
            stream, str(tmp_path / "out"), str(tmp_path / "progress"), horizon="2 days", available_now=True
        )
        query.awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [9]
    (tmp_path / "in" / "b.json").write_text("\n".join(json.dumps({**base, **p}) for p in posts))
    assert run() == [1, 2, 3, 9]


def test_word_counts_travel_once_a_text_and_stay_by_key(spark):
    """Counts of repeated and null keys, and no sort of the counts by bucket."""
    from kohorta.operators import embedding

    rows = [(1, "b a a é"), (1, "A, c"), (None, "a"), (None, "z z"), (2, None), (3, "日本 it's")]
    texts = spark.createDataFrame(rows, "id long, prep string").repartition(3)
    counts = embedding._bucket_counts(texts, "id", embedding.F.col("prep"), 1 << 18)
    import hashlib

    def bucket(w):
        return int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % (1 << 18)

    expected = [(1, "a", 3), (1, "b", 1), (1, "c", 1), (1, "é", 1), (None, "a", 1), (None, "z", 2), (3, "日本", 1), (3, "it", 1), (3, "s", 1)]
    assert sorted(map(tuple, counts.collect()), key=str) == sorted(((k, bucket(w), n) for k, w, n in expected), key=str)
    plan = embedding.tfidf_rows(texts)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(bucket" in plan
