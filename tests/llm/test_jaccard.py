import re
from collections import Counter

import numpy as np

from kohorta.llm import jaccard as J
from kohorta.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def gram_set(text, size):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if 0 < len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def slow_rows(docs, size, percent):
    """All pairs, then the smallest id reached."""
    sets = [gram_set(t, size) for _, t in docs]
    comp = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    out = []
    for i, (doc_id, _) in enumerate(docs):
        ids = [d for (d, _), c in zip(docs, comp, strict=True) if c == comp[i] and d is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return out


def corpus():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    common = list(rng.choice(vocabulary, 30))
    for i in range(40):
        base = list(rng.choice(vocabulary, int(rng.integers(3, 120))))
        if i % 3 == 0:
            base += common
        for _ in range(int(rng.integers(1, 5))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, len(copy)))] = "edit"
            docs.append((len(docs), " ".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy)))
    base = list(rng.choice(vocabulary, 200))
    for i in range(120):  # one large group of near copies
        copy = list(base)
        for k in rng.integers(0, 200, i % 6):
            copy[k] = f"x{i}"
        docs.append((len(docs), " ".join(copy)))
    return docs + [(500, ""), (501, None), (502, " \n"), (503, "a b"), (504, "A  b"), (505, "a"), (7, docs[0][1]), (7, docs[0][1])]


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_components_equal_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, node int, prefix int").repartition(5)
    for size, percent in ((4, 85), (5, 80)):
        got = J.link_components(frame, size, percent).select("doc_id", "n_shingles", "component_id").collect()
        assert key(map(tuple, got)) == key(slow_rows(docs, size, percent))


def test_frequent_grams_do_not_change_the_result(spark, monkeypatch):
    docs = corpus()
    for name, value in (("LIGHT_LEVEL", 8), ("CELL_BITS", 16)):
        monkeypatch.setattr(J, name, value)
        got = J.link_components(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85)
        rows = got.select("doc_id", "n_shingles", "component_id").collect()
        assert key(map(tuple, rows)) == key(slow_rows(docs, 4, 85))


def test_levels_count_all_texts(spark):
    texts = ["a b c d", "a b c d e", "x"] * 7
    levels = J.frequency_levels(spark.createDataFrame([(t,) for t in texts], "t string").repartition(3), 4, "t")
    counts = Counter(g for t in texts for _, _, _, gram in J.gram_sets(J.pa.array([t]), 4) for g in gram.tolist())
    for gram, n in counts.items():
        assert levels[gram >> (64 - J.CELL_BITS)] >= J._level(np.array([n]))[0]
    assert sorted(set(levels.tolist())) == sorted({0, *J._level(np.array(list(counts.values()))).tolist()})


def test_edges(spark):
    docs = [(None, "one two three four five"), (None, "one two three four five"), (3, "one two three four five"), (None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = J.link_components(frame).select("doc_id", "n_shingles", "component_id").collect()
    assert key(map(tuple, got)) == key([(None, 2, 3), (None, 2, 3), (3, 2, 3), (None, 0, None)])
    assert J.link_components(frame.limit(0)).count() == 0


def test_one_of_each(spark):
    docs = corpus() + [(None, "q r s t u v"), (None, "q r s t u v")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, component int")
    kept = J.one_of_each(frame)
    assert kept.columns == frame.columns
    filled = [d for d in docs if gram_set(d[1], 5)]
    want = {r[2] for r in slow_rows(filled, 5, 80)}
    rows = kept.collect()
    assert sorted((r.doc_id for r in rows if WORD.search(r.text or "")), key=str) == sorted(want, key=str)
    assert sum(not WORD.search(r.text or "") for r in rows) == 3


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 100)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(90, 90), (95, 90), (100, 90)}
