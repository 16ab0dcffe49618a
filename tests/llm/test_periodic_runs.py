import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from kohorta.llm import periodic_runs as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words):
    """All runs by trying every period at every place."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                start, end = i, j + q
                if end - start >= max(6, 4 * q):
                    best.setdefault((start, end), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def changed(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def slow_row(doc_id, text):
    words = changed(doc_id, WORD.findall(text or ""))
    runs = slow_runs(words)
    gone = set()
    for s, n, q in runs:
        gone.update(range(s + q, s + n))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), s, n, q, runs and 1000 * n // q or None,
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, period string").repartition(3)
    got = R.periodic_runs(frame, change=R.repeated_words).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[6], r[7])
    assert sorted(map(tuple, got), key=order) == sorted((slow_row(*r) for r in rows), key=order)


def test_random_texts_equal_brute_force(spark):
    rng, rows = random.Random(3), []
    for i in range(400):
        letters = "abcdefgh"[: rng.randint(1, 5)]
        part = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
        words = [rng.choice(letters) for _ in range(rng.randint(0, 12))] + part * rng.randint(1, 9)
        words += part[: rng.randint(0, len(part))] + [rng.choice(letters) for _ in range(rng.randint(0, 30))]
        rows.append((i, " ".join(words)))
    check(spark, rows)


def test_edges(spark):
    rows = [(None, None), (None, ""), (None, "a " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a a a a a a"),
            (5, "a\x0ba\ta\na a"), (6, "ä ö " * 4), (6, "ä ö " * 4), (7, "\xa0 \xa0 \xa0 \xa0 \xa0 \xa0"), (8, "x " + "m " * 3000)]
    rows += [(i, "one two three four five six seven eight nine ten") for i in range(100, 160)]
    check(spark, rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.periodic_runs(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 64, 333])
def test_wavelet_tree(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 2 * n, n)
    tree = R.WaveletTree(values)
    left = rng.integers(0, n, 50)
    right = left + rng.integers(1, n + 1, 50).clip(max=n - left)
    bound = rng.integers(0, 5 * n, 50)
    want = [(values[a:b] < x).sum() for a, b, x in zip(left, right, bound, strict=True)]
    assert tree.below(left, right, bound).tolist() == want
    k = rng.integers(0, right - left)
    assert tree.kth(left, right, k).tolist() == [sorted(values[a:b])[i] for a, b, i in zip(left, right, k, strict=True)]


def test_query_on_the_smallest_tables(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = [r for r in rows if len(WORD.findall(r[1] or "")) < 700]
    got = {r.doc_id: tuple(r) for r in R.query(spark, small).collect()}
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    for r in rows:
        assert got[r[0]] == slow_row(*r)
