import zlib

import numpy as np
import pyarrow as pa
import pytest

from kohorta.llm import toxicity as X

TEXTS = ["", None, "ab", "An IDIOT wrote\tthis", "idiot " * 400, "é日本 " * 50, "x" * 3_000_000, "an idiot wrote this"]


def slow_buckets(text):
    """Buckets of all n-grams of one text, byte by byte."""
    folded = [32 if b in b" \t\n\r\x0b\x0c" else b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()]
    out = set()
    for n in X.ORDERS:
        for i in range(len(folded) - n + 1):
            total = sum(int(X._LANES[k][folded[i + k]]) for k in range(n)) % 2**32
            out.add((total * 2654435761 % 2**32) >> (32 - X.BITS))
    return out


def test_scores_equal_definition():
    rng = np.random.default_rng(3)
    chosen = np.full(X.BUCKETS, -1)
    some = rng.choice(X.BUCKETS, 60_000, replace=False)
    chosen[some] = np.arange(len(some))
    weights = rng.normal(0, 0.1, len(some))
    model = X.Model(chosen, weights, -0.3)
    want = [-0.3 + sum(weights[chosen[b]] for b in slow_buckets(t) if chosen[b] >= 0) for t in TEXTS[:6]]
    got = model.scores(pa.array(TEXTS))
    assert got[:6] == pytest.approx(1 / (1 + np.exp(-np.array(want))), abs=1e-12)
    assert got[3] == got[7]


def test_edges(spark):
    docs = spark.createDataFrame(
        [(None, "x", 1.0), (1, None, 2.0), (2, "", 2.0), (2, "", 2.0)], "doc_id long, text string, score double"
    )
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    assert [r.score for r in X.score(docs, model).collect()] == pytest.approx([0.0] * 4)
    assert X.score(docs.limit(0), model).count() == 0
    flags = docs.select(X.held_out(docs.doc_id).alias("h")).collect()
    want = [False if i is None else zlib.crc32(str(i).encode()) % 3 == 1 for i in (None, 1, 2, 2)]
    assert [r.h for r in flags] == want


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = X.query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = got.filter("held_out").toPandas()
    toxic = rows.toxic == 1
    assert rows.predicted[toxic].mean() > 0.7
    assert rows.predicted[~toxic].mean() < 0.02
    assert rows.score.between(0, 1).all()
