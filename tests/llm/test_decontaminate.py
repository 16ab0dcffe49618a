import re

import numpy as np

from kohorta.llm import decontaminate as D


def slow_pairs(docs, items, percent=80):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    classes = {}
    for item_id, text in items:
        w = words(text)
        if w:
            key = frozenset(grams(w, min(5, len(w))))
            classes[key] = min(item_id, classes.get(key, item_id))
    out = set()
    for doc_id, text in docs:
        w = words(text)
        for key, item in classes.items():
            n = len(key & grams(w, len(next(iter(key)))))
            if n and 100 * n >= percent * len(key):
                out.add((doc_id, item, n, len(key)))
    return out


def test_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(int(rng.integers(1, 40)))) for i in range(30)] + [(30, ""), (31, None)]
    items += [(32, items[7][1]), (33, "A, b!"), (34, "the the the the the the the")]
    docs = []
    for i in range(60):
        inner = items[int(rng.integers(0, 30))][1].split()
        for _ in range(int(rng.integers(0, 3))):
            inner[int(rng.integers(0, len(inner)))] = "changed"
        docs.append((i, f"{text(50)} {' '.join(inner).upper()} {text(30)}"))
    docs += [(100, None), (101, ""), (102, "x a B c"), (103, text(40_000)), (104, "the " * 50)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    t = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in D.contained_items(d, t).collect()}
    assert got == slow_pairs(docs, items) and len(got) > 20
    clean = D.clean_documents(d, t)
    assert clean.columns == d.columns
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in docs} - {r[0] for r in got}


def test_edges(spark):
    line = "one two three four five six seven"
    docs = spark.createDataFrame([(None, line), (None, "x"), (5, line), (5, line), (5, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(None, line), (9, line)], "item_id long, text string")
    assert {tuple(r) for r in D.contained_items(docs, items).collect()} == {(None, 9, 3, 3), (5, 9, 3, 3)}
    assert {tuple(r) for r in D.clean_documents(docs, items).collect()} == {(None, "x"), (5, "clean")}
    assert D.contained_items(docs, items.limit(0)).count() == 0
    assert D.contained_items(docs.limit(0), items).count() == 0
    assert D.clean_documents(docs, items.limit(0)).count() == 5


def test_rows_with_one_id_are_judged_alone(spark):
    """Neither a clean row nor an item is lost to another row or item without id."""
    line, other = "one two three four five six seven", "red green blue white black grey pink"
    docs = spark.createDataFrame(
        [(None, f"a {line} b"), (None, "clean"), (7, other), (7, "clean too"), (9, "x")], "doc_id long, text string"
    )
    for ids in ((None, None), (3, 3), (1, 2)):
        items = spark.createDataFrame(list(zip(ids, (line, other), strict=True)), "item_id long, text string")
        got = sorted(D.contained_items(docs, items).select("item_id", "n_shared").collect(), key=str)
        assert [r.n_shared for r in got] == [3, 3] and {r.item_id for r in got} == set(ids)
        assert {r.text for r in D.clean_documents(docs, items).collect()} == {"clean", "clean too", "x"}


def test_sketch_cannot_miss(spark):
    for size in range(1, 300):
        k = size - -(-size * 80 // 100) + 1
        upper = 2 ** (size.bit_length()) - 1
        assert min(size, upper - -(-upper * 80 // 100) + 1) >= k
