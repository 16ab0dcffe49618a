import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kohorta.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_statistics(text):
    """Rule statistics of one text, straight from their definition."""
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return [len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), len(lines)]


def texts():
    rng = np.random.default_rng(0)
    some = ["a", "bb", "é", "|", "c d", "日本", "x#y", "<b>"]
    made = [" ".join(rng.choice(some, rng.integers(0, 60))) for _ in range(60)]
    made += [t.replace(" bb ", "\n") for t in made] + [("a b\n" * 30), " \n\n \t", "", None, "\n", "a\n", "\na"]
    return made + ["w " * 300_000, "one two three four five six seven eight " * 3, "a\x0bb\x0cc\x1cd"]


def test_statistics_match_definition():
    found = Q.statistics(pa.array(texts()))
    assert found.tolist() == [slow_statistics(t) for t in texts()]


def test_statistics_of_no_rows():
    assert Q.statistics(pa.array([], pa.string())).shape == (0, 6)


def test_forest_isolates_the_odd_row():
    rng = np.random.default_rng(1)
    rows = np.r_[rng.normal(0, 1, (500, 4)), np.full((5, 4), 9.0)]
    forest = Q.Forest.grow(rows, (0, 1, 2, 3), 64, 256, 3).calibrate(rows[:500], 0.002)
    scores = forest.scores(rows)
    assert (scores[500:] > forest.threshold).all()
    assert (scores[:500] > forest.threshold).sum() <= 1


def test_judge_edges(spark):
    rows = [(None, None, "x"), (1, "", "x"), (2, "word " * 30, "x"), (2, "word " * 30, "x"),
            (3, " ".join(f"w{i}" for i in range(40)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(3, None), (None, 1)], "doc_id long, quality int")
    forests = Q.fit_forests(docs, labels)
    got = sorted(Q.judge(docs, forests, carry=docs.columns[:1]).collect(), key=lambda r: (r.doc_id or 0, r.kept))
    assert [(r.doc_id, r.base_failed, r.kept) for r in got] == [
        (None, True, False), (1, True, False), (2, True, False), (2, True, False), (3, False, True),
    ]
    assert Q.judge(docs.limit(0), forests).count() == 0


def test_stage_keeps_clashing_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("*", "1 AS kept", "2 AS c0")
    out = Q.keep_good(spark, docs, small)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_held_out_labels(spark, folder):
    """Forests of one half of the labels judge the other half."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    forests = Q.fit_forests(docs, labels.filter("doc_id % 2 = 0"))
    judged = Q.judge(docs, forests).join(labels.filter("doc_id % 2 = 1 AND toxic = 0"), "doc_id").toPandas()
    passed = judged[~judged.base_failed]
    assert passed[passed.quality == 1].kept.mean() > 0.97
    assert passed[passed.quality == 0].kept.mean() < 0.1


def test_all_labelled_texts_are_drawn_from_and_counted(spark, monkeypatch):
    """More labelled texts than any bound of a sample: thresholds are those of all good ones."""
    n = 30_000
    docs = spark.range(n).selectExpr(
        "id AS doc_id", "concat(repeat('some words here ', 2 + cast(id % 50 AS int)), repeat('|', cast(pmod(hash(id), 40) AS int)), ' ', "
        "array_join(transform(sequence(1, 20), i -> concat('w', hash(id, i))), ' ')) AS text"
    ).unionByName(spark.range(7).selectExpr("cast(3 AS long) AS doc_id", "'copy' AS text"))
    labels = spark.range(n).selectExpr("id AS doc_id", "cast(id % 3 > 0 AS int) AS quality")
    rows = Q.labelled_statistics(docs, labels)
    assert rows.agg({"__copies": "sum"}).first()[0] == n + 7
    forests = Q.fit_forests(docs, labels, n_trees=8)
    table = rows.toPandas()
    stats = table[list(Q.STATISTICS)].to_numpy()
    keep = ~Q.base_failed(stats) & (table["__quality"].to_numpy() == 1)
    for forest in forests:
        plain = Q.Forest(forest.view, forest.trees, forest.scale).calibrate(Q.features(stats)[keep], 0.0005)
        assert forest.threshold == pytest.approx(plain.threshold, abs=1e-12)
    draws = Q.tree_draws(rows, 8, 256, 17)
    assert [len(d) for d in draws] == [256] * 8 and not np.array_equal(draws[0], draws[1])
    passed = {tuple(x) for x in Q.features(stats)[~Q.base_failed(stats)]}
    assert all(tuple(x) in passed for d in draws for x in d)


def test_value_at_rank(spark):
    rng = np.random.default_rng(5)
    values = [rng.random(700), np.r_[np.full(400, 0.25), rng.random(300) ** 9]]
    rows = [(f, int(x), 1 + i % 3) for f, v in enumerate(values) for i, x in enumerate(v.view(np.int64))]
    frame = spark.createDataFrame(rows, "forest long, bits long, copies long")
    for rank in (0, 1, 699, 1000, 1398):
        plain = [int(np.sort(np.repeat(v, 1 + np.arange(700) % 3))[rank].view(np.int64)) for v in values]
        assert Q.at_rank(frame, rank, 2) == plain
