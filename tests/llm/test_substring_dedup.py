import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from kohorta.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows, width=13):
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        if d is not None:
            for i in range(len(w) - width + 1):
                key = tuple(w[i : i + width])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - width + 1) if d is not None else ():
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def check(spark, rows, parts=4):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, low int, spans string")
    got = S.remove_repeats(frame.repartition(parts)).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0, *r[1:])) == slow(rows)


def passages(rng, vocabulary, count, least, most):
    return [[rng.choice(vocabulary) for _ in range(rng.randint(least, most))] for _ in range(count)]


def test_shared_passages_equal_brute_force(spark):
    rng = random.Random(5)
    many, few = [f"w{i}" for i in range(3000)], ["a", "b", "c"]
    shared = passages(rng, many, 30, 8, 60) + passages(rng, few, 10, 10, 30)
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(1, 6)):
            words += rng.choice(shared) if rng.random() < 0.5 else rng.choice(passages(rng, many, 1, 0, 40))
            if rng.random() < 0.3 and words:
                words[rng.randrange(len(words))] = "changed"
        rows.append((1000 - i, " ".join(words)))
    rows += rows[:40]
    rows += [(2000 + i, rows[i % 7][1]) for i in range(60)]
    check(spark, rows)


def test_branches_and_periods(spark):
    base = [f"p{i}" for i in range(40)]
    rows = [(9, " ".join(base)), (3, " ".join(base[:25] + ["x"] + base[25:])), (5, " ".join(base[10:] + base[:30])), (1, " ".join(base[20:33])),
            (20, "m " * 500), (21, "m " * 13), (22, "m " * 12), (23, "k " + "m " * 300), (24, "ab " * 40 + "m " * 30),
            (30, " ".join(base) + " " + " ".join(base))]
    check(spark, rows)


def test_edges(spark):
    long = " ".join(f"q{i}" for i in range(30_000))
    rows = [(None, None), (None, long), (1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, long), (6, "x " + long), (6, long), (7, long.replace(" ", "\n\x0b")),
            (8, long.upper()), (9, "é " * 13), (10, "é\xa0" * 13 + " " + "é " * 13)]
    check(spark, rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(none).count() == 0
    alone = spark.createDataFrame([(1, "a " * 50), (None, "a " * 50)], "doc_id long, text string")
    assert [r.n_removed for r in S.remove_repeats(alone).collect()] == [0, 0]


def test_equal_hashes_are_caught_by_the_source(spark, monkeypatch):
    """Windows that only share a hash: the source's words differ, so nothing goes."""
    rows = [(1, " ".join(f"a{i}" for i in range(13))), (2, " ".join(f"b{i}" for i in range(13)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    digests = {r.doc_id: r.digest for r in S._source(frame, "doc_id", "text").collect()}
    spans = spark.createDataFrame([(2, digests[2], [(0, 1, 1, digests[1], 0)])], f"doc_id long, digest long, spans array<{S.SPAN}>")
    monkeypatch.setattr(S, "repeated_spans", lambda *a: spans)
    assert [r.n_removed for r in S.remove_repeats(frame).collect()] == [0, 0]


def test_spans_name_their_source(spark):
    base = " ".join(f"p{i}" for i in range(40))
    frame = spark.createDataFrame([(1, "x y " + base), (2, "z " + base + " end")], "doc_id long, text string")
    row = S.repeated_spans(frame).first()
    assert [(s.start, s.n, s.low, s.source) for s in row.spans] == [(1, 28, 1, 2)]


def test_hashes_that_are_not_asked_for_are_left_out():
    texts = pa.array([" ".join(f"w{i % 17}" for i in range(40)), None, "few words", " ".join("x" * 13)])
    block = next(S.Block(data, offsets) for _, data, offsets in S.text_blocks(texts))
    whole = S.window_runs(block, 13)
    words = block.word_hashes()
    nodes, begin = S._by_place(words, block.doc, 12), np.searchsorted(block.doc, np.arange(block.n))
    start = begin[whole[0]] + whole[1]
    assert (whole[5] == nodes[start]).all() and (whole[6] == nodes[start + whole[2]]).all()
    bare = S.window_runs(block, 13, named=False, nodes=False)
    assert all((a == b).all() for a, b in zip(bare[:4], whole[:4], strict=True))
    assert [len(column) for column in bare[4:]] == [0, 0, 0]
