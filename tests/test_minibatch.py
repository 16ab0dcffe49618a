"""Mini-batch training against a plain NumPy run, and choice of candidates."""

import hashlib

import numpy as np
import pytest

from kohorta.operators import minibatch as M

RULE = M.Rule(epochs=3, batch=8, rate=0.05, warmup=6, features=1 << 10)


def examples(spark, n=90):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        words = ["good", "fine", "happy"] if i % 3 else ["bad", "sad", "ill"]
        rows.append((i, " ".join(rng.choice([*words, "the", "of", "and"], 12)), int(bool(i % 3))))
    return spark.createDataFrame(rows, "id long, text string, label int")


def numpy_run(spark, frame, rule, shards=1):
    """AdamW on dense rows, written independently of the operator."""
    got = M.word_buckets(frame, rule.features).collect()
    n, width = len(got), rule.features
    df = np.zeros(width)
    for r in got:
        df[list(set(r.buckets))] += 1
    idf = np.log((n + 1) / (df + 1))
    x = np.zeros((n, width + 1))
    for k, r in enumerate(got):
        for b in r.buckets:
            x[k, b] += idf[b]
    x[:, -1] = 1
    y = np.array([r.label for r in got], float)
    from pyspark.sql import functions as F

    shard = F.pmod(F.xxhash64(M._digest("id", rule.seed, "shard")), F.lit(shards)).alias("s")
    home = {r.id: r.s for r in frame.select("id", shard).collect()}
    state = [np.zeros(width + 1) for _ in range(3)]
    weights, losses = [], []
    for epoch in range(rule.epochs):
        sums, loss = [np.zeros(width + 1) for _ in range(3)], 0.0
        for s in range(shards):
            own = [k for k in range(n) if home[got[k].id] == s]
            own.sort(key=lambda k: hashlib.md5(f"{rule.seed}:{epoch}:{got[k].id}".encode()).hexdigest())
            w, m, v = (a.copy() for a in state)
            each = -(-len(own) // rule.batch)
            for b in range(each):
                t = epoch * each + b + 1
                part = own[b * rule.batch : (b + 1) * rule.batch]
                z = x[part] @ w
                loss += np.sum(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y[part] * z)
                g = x[part].T @ (1 / (1 + np.exp(-z)) - y[part]) / len(part)
                m = 0.9 * m + 0.1 * g
                v = 0.999 * v + 0.001 * g * g
                total = rule.epochs * each
                lr = rule.rate * t / rule.warmup if t <= rule.warmup else rule.rate * (total - t) / (total - rule.warmup)
                keep = np.r_[np.full(width, 1 - lr * rule.decay), 1.0]
                w = w * keep - lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            for a, b in zip(sums, (w, m, v), strict=True):
                a += b * len(own)
        state = [a / n for a in sums]
        weights.append(state[0])
        losses.append(loss / n)
    return weights, losses


@pytest.mark.parametrize(("rows", "shards"), [(50_000, 1), (30, 3)])
def test_weights_after_each_epoch_equal_numpy(spark, rows, shards):
    from dataclasses import replace

    rule = replace(RULE, shard_rows=rows)
    frame = examples(spark)
    got = M.train(frame.repartition(5), rule)
    weights, losses = numpy_run(spark, frame, rule, shards)
    assert got.loss == pytest.approx(losses)
    for a, b in zip(got.weights, weights, strict=True):
        np.testing.assert_allclose(a, b, atol=1e-9)
    assert got.losses(spark).count() == 3 and got.loss[2] < got.loss[0]


def test_rate_rises_and_falls():
    rule = M.Rule(rate=1.0, warmup=4)
    assert [M.rate_at(s, 12, rule) for s in (1, 4, 8, 12)] == [0.25, 1.0, 0.5, 0.0]


def test_all_epochs_are_predicted_in_one_pass(spark):
    frame = examples(spark)
    trained = M.train(frame, RULE)
    got = M.choose(M.candidate_metrics(M.predict(frame, trained))).orderBy("candidate").collect()
    assert [r.candidate for r in got] == [1, 2, 3] and sum(r.chosen for r in got) == 1
    assert got[-1].accuracy > 0.95 and all(r.tp + r.fp + r.fn + r.tn == 90 for r in got)


def test_no_examples(spark):
    frame = examples(spark).limit(0)
    assert M.train(frame, RULE).weights == []


def metrics(spark, f1):
    return spark.createDataFrame([(i, float(x), 0.5) for i, x in enumerate(f1, 1)], "candidate int, f1 double, accuracy double")


@pytest.mark.parametrize(
    ("f1", "patience", "chosen"),
    [([0.1, 0.5, 0.5], None, 2), ([0.1, 0.5, 0.4, 0.9], None, 4), ([0.1, 0.5, 0.4, 0.9], 1, 2), ([0.1, 0.5, 0.4, 0.9], 2, 4),
     ([0.1, 0.5, 0.4, 0.3, 0.9], 2, 2), ([0.1, 0.5, 0.4, 0.3, 0.9], 3, 5), ([0.3], 1, 1), ([0.3, 0.2, 0.1, 0.8], 2, 1)],
)
def test_choice_and_early_stop(spark, f1, patience, chosen):
    got = M.choose(metrics(spark, f1), patience=patience).filter("chosen").collect()
    assert [r.candidate for r in got] == [chosen]


def test_a_shard_streams_through_its_task():
    """Batches of any size give what the whole shard gives, and no more than a few are held."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    lists = [rng.integers(0, 1 << 10, rng.integers(0, 9)).astype(np.int32) for _ in range(83)]
    labels, idf, start = rng.integers(0, 2, 83).astype(float), rng.random(1 << 10), rng.random((3, (1 << 10) + 1))
    homes = np.r_[np.full(50, 4), np.full(33, 9)].astype(np.int32)
    held = []

    def batches(step):
        for i in range(0, 83, step):
            held.append(i)
            part = slice(i, i + step)
            size = np.where(homes[part] == 4, 50, 33)
            yield pa.RecordBatch.from_arrays(
                [pa.array(homes[part]), pa.array(size), pa.array(labels[part]), pa.array(lists[part], pa.list_(pa.int32()))],
                names=["shard", "size", "label", "buckets"],
            )

    expected = []
    for a, b in ((0, 50), (50, 83)):
        state, each = start.copy(), -(-(b - a) // RULE.batch)
        loss = M.run_batches(lists[a:b], labels[a:b], state, 2 * each, RULE.epochs * each, idf, RULE)
        expected.append((loss, (state.ravel() * (b - a)).tobytes()))
    for step in (1, 7, 8, 50, 83):
        found = list(M.shard_epoch(batches(step), 2, start, idf, RULE))
        assert [(f["loss"][0].as_py(), b"".join(f["part"].to_pylist())) for f in found] == expected
    held.clear()
    next(M.shard_epoch(batches(1), 2, start, idf, RULE))
    assert len(held) == 51


def test_a_missing_label_is_no_number(spark):
    """A null label makes the loss of its shard NaN, and nothing fails."""
    rows = [(i, "good day" if i % 2 else "bad day", None if i == 5 else i % 2) for i in range(20)]
    trained = M.train(spark.createDataFrame(rows, "id long, text string, label int"), RULE)
    assert len(trained.loss) == 3 and np.isnan(trained.loss).all()
