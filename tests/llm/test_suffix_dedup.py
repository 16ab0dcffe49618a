import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from kohorta.llm import suffix_dedup as S
from kohorta.llm.suffix_array import suffix_array


def test_suffix_array_equals_sorting():
    rng = random.Random(1)
    for _ in range(1500):
        symbols = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
        assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def slow_rows(docs, length):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(60, 160)) for _ in range(6)]
    docs = []
    for i in range(80):
        body = text(rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            cut = rng.randint(0, len(body))
            p = rng.choice(passages)
            p = p[rng.randint(0, 30) : len(p) - rng.randint(0, 30)]
            body = body[:cut] + p + body[cut:]
        docs.append((i, body))
    docs += [(100 + i, docs[i][1]) for i in range(10)]
    docs += [(5, docs[5][1]), (None, docs[6][1]), (200, None), (201, ""), (202, "x" * 2000), (203, "ab" * 300),
             (204, "For " * 500 + text(50)), (205, "For " * 400), (206, passages[0] * 3), (207, "y" * 400)]
    return docs


def digests(spark, docs, monkeypatch, length=400, **changes):
    for name, value in changes.items():
        monkeypatch.setattr(S, name, value)
    frame = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, uid int, runs string")
    rows, changed = S.remove_repeats(frame.repartition(4), length)
    done = {r.uid: r for r in changed.collect()}
    out = []
    for r in rows.collect():
        c = done.get(r.uid)
        sha = hashlib.sha256(c.kept).hexdigest() if c else r.sha256
        out.append((r.doc_id, r.n_bytes, c.n_removed if c else 0, len(c.spans) if c else 0, sha))
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, monkeypatch, seed):
    docs = corpus(seed)
    assert digests(spark, docs, monkeypatch) == slow_rows(docs, 400)


def test_hot_anchors_in_classes(spark, monkeypatch):
    docs = corpus(3)
    assert digests(spark, docs, monkeypatch, HOT=1, BATCH_BYTES=5_000) == slow_rows(docs, 400)


def test_other_length_and_tiles(spark, monkeypatch):
    docs = corpus(4)[:30]
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(9_000))
    docs += [(900, long), (901, long[3_000:5_000])]
    assert digests(spark, docs, monkeypatch, 100, TILE=1_000) == slow_rows(docs, 100)


def test_query_equals_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert Counter(map(tuple, S.query(spark, small).collect())) == slow_rows(docs, 400)


def test_empty_table(spark):
    rows, changed = S.remove_repeats(spark.createDataFrame([], "doc_id long, text string"))
    assert rows.count() == 0 and changed.count() == 0


def test_nothing_repeats_among_texts_that_share_an_anchor(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(390)
    docs = [(i, text(100) + shared + text(100)) for i in range(3)]
    assert digests(spark, docs, monkeypatch) == slow_rows(docs, 400)
    assert all(len(x) == 0 for x in S.covered_ranges(np.zeros(0, int), np.zeros(0, int), 400))


@pytest.mark.parametrize("size, gone", [(399, 0), (400, 400)])
def test_a_passage_of_over_50_words_goes_from_400_bytes_on(spark, monkeypatch, size, gone):
    rng = random.Random(3)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))[:size]
    assert len(passage.split()) > 50
    docs = [(i, f"{i}" * 150 + passage + f"{i}" * 150) for i in range(5)]
    done = digests(spark, docs, monkeypatch)
    assert done == slow_rows(docs, 400) and {row[2] for row in done} == {gone}


def test_ranges_of_windows():
    who, lo, hi = S.covered_ranges(np.array([0, 0, 0, 1]), np.array([0, 10, 21, 0]), 10)
    assert (who.tolist(), lo.tolist(), hi.tolist()) == ([0, 0, 1], [0, 21, 0], [20, 31, 10])


def test_no_key_gathers_the_texts_that_quote_a_passage(spark, monkeypatch, tmp_path):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(900)
    docs = [(i, text(150) + passage + text(150)) for i in range(200)]
    real, folder = S._mark, str(tmp_path)

    def counted(length):
        mark = real(length)

        def run(batches):
            keys = Counter()

            def noted():
                for batch in batches:
                    keys.update(batch.column(0).to_pylist())
                    yield batch

            yield from mark(noted())
            if keys:
                with open(f"{folder}/{random.random()}", "w") as f:
                    f.write(str(max(keys.values())))

        return run

    monkeypatch.setattr(S, "_mark", counted)
    assert digests(spark, docs, monkeypatch, HOT=20) == slow_rows(docs, 400)
    assert max((int(f.read_text()) for f in tmp_path.iterdir()), default=0) <= 20
