import math
import re
from collections import Counter

import pytest

from kohorta.llm import cross_entropy as C

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_scores(docs, targets):
    """Scores from dictionaries."""
    split = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words = Counter(w for _, t in docs for w in split(t))
    models = []
    for some in ([t for _, t in docs], [t for d, t in docs if d in targets]):
        one, context, two = Counter(), Counter(), Counter()
        for t in some:
            w = ["<s>", *split(t)]
            one.update(w[1:])
            context.update(w[:-1])
            two.update(zip(w, w[1:], strict=False))
        models.append((one, context, two))
    out = []
    for doc_id, t in docs:
        w, losses = ["<s>", *split(t)], [0.0, 0.0]
        for k, (one, context, two) in enumerate(models):
            for a, b in zip(w, w[1:], strict=False):
                own = (one[b] + 1) / (sum(one.values()) + len(words) + 1)
                losses[k] -= math.log((two[a, b] + C.MASS * own) / (context[a] + C.MASS))
        n = max(len(w) - 1, 1)
        out.append((doc_id, len(w) - 1, losses[1] / n, losses[0] / n, (losses[0] - losses[1]) / n))
    return out


def docs():
    good = "the cat sat on the mat and the dog sat too"
    bad = "zzz | qqq | zzz | The zzz"
    return [(i, f"{good} {i % 5}") for i in range(20)] + [(100 + i, f"{bad} {i % 3}") for i in range(9)] + [
        (None, "the cat"), (200, ""), (201, None), (3, "the cat sat"), (300, "mat " * 20_000)]


def test_scores_equal_definition(spark):
    rows = docs()
    targets = set(range(20))
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    ids = spark.createDataFrame([(i,) for i in [*targets, None]], "doc_id long")
    got = C.exact_scores(frame, ids).collect()
    order = lambda r: (r[0] is None, r[0], r[1])
    want = sorted(slow_scores(rows, targets), key=order)
    for a, b in zip(sorted(map(tuple, got), key=order), want, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-5)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[5] > by_id[105]


def test_edges(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = frame.select("doc_id").limit(0)
    row = C.exact_scores(frame, none).first()
    assert row.target_loss == pytest.approx(math.log(3))
    assert C.exact_scores(frame.limit(0), none).count() == 0


def test_good_texts_score_higher(spark, small):
    got = C.query(spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id")
    mean = {r.quality: r.s for r in got.groupBy("quality").agg({"score": "avg"}).toDF("quality", "s").collect()}
    assert mean[1] > mean[0]


def test_query_counts_every_word_and_pair(spark, tmp_path):
    rows = [*docs(), (400, "one two three four"), (401, "Four one two three"), (402, "one two three four")]
    targets = {*range(20), 401}
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    ids = spark.createDataFrame([*[(i, 1) for i in targets], (None, 1), (400, 0)], "doc_id long, quality int")
    ids.write.parquet(f"{tmp_path}/labels.parquet")
    order = lambda r: (r[0] is None, r[0], r[1])
    want = sorted(slow_scores(rows, targets), key=order)
    got = sorted(map(tuple, C.query(spark, tmp_path).collect()), key=order)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-5)


@pytest.mark.parametrize("block, cell, least", [(1, 1, 1), (7, 100, 3), (1 << 20, 1 << 21, 1)])
def test_sizes_of_blocks_and_cells_change_nothing(spark, block, cell, least):
    rows, targets = docs(), set(range(20))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in targets], "doc_id long")
    sizes = {"block_tokens": block, "cell_tokens": cell, "least_cells": least}
    order = lambda r: (r[0] is None, r[0], r[1])
    got = sorted(map(tuple, C.exact_scores(frame, ids, **sizes).collect()), key=order)
    for a, b in zip(got, sorted(slow_scores(rows, targets), key=order), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)


def test_ids_of_another_type(spark):
    frame = spark.createDataFrame([("1", "a b"), ("x", "a c"), (None, "d")], "doc_id string, text string")
    got = C.exact_scores(frame, spark.createDataFrame([(1,), (None,)], "doc_id long")).collect()
    want = slow_scores([(1, "a b"), ("x", "a c"), (None, "d")], {1})
    for a, b in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(want, key=lambda r: str(r[0])), strict=True):
        assert tuple(a[1:]) == pytest.approx(b[1:], abs=1e-9)


def test_carried_columns(spark):
    frame = spark.createDataFrame([(1, "a b", [1, None], "x"), (2, None, None, None)], "doc_id long, text string, n array<int>, `n.tokens` string")
    got = C.exact_scores(frame, frame.select("doc_id"), carry=("n.tokens", "n", "doc_id")).orderBy("doc_id").collect()
    assert [tuple(r[:4]) for r in got] == [("x", [1, None], 1, 2), (None, None, 2, 0)]
    assert tuple(got[1][4:]) == (0.0, 0.0, 0.0)


def test_exact_scores_of_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert C.exact_scores(none, none).count() == 0


def test_targets_never_pass_through_the_driver(spark, monkeypatch):
    plans, cut = {}, C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df, name, **o: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), cut(df, name, **o))[1])
    frame = spark.createDataFrame([(i, "a b") for i in range(9)], "doc_id long, text string")
    C.exact_scores(frame, spark.createDataFrame([(1,)], "doc_id long")).count()
    assert "SortMergeJoin" in plans["cross-entropy-targets"] and "BroadcastExchange" not in plans["cross-entropy-targets"]
