import random
import re
import tracemalloc
from collections import Counter

import numpy as np

from kohorta.llm import collocations as C
from kohorta.llm.two_way_index import TwoWayIndex


def slow(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cands = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cands.items():
        inside = (
            a2 >= a for (lang2, q), a2 in cands.items()
            if lang2 == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
        )
        if any(inside):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(own[:top], 1)]
    return sorted(ranked)


def check(spark, rows, least=4, top=50, parts=3):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, phrase string").repartition(parts)
    got = sorted(map(tuple, C.collocations(frame, least=least, top=top).collect()))
    assert got == slow(rows, least, top)
    return got


def sample(rng, count):
    words = [f"w{i}" for i in range(60)] + ["The", "the", "a", "ÉTÉ", "été"]
    fixed = [["new", "york", "city"], ["a", "b", "a", "b"], ["x", "x", "x"], ["one", "two", "three", "four", "five", "six"]]
    rows = []
    for _ in range(count):
        text = ""
        for _ in range(rng.randint(0, 12)):
            part = rng.choice(fixed) if rng.random() < 0.4 else [rng.choice(words) for _ in range(rng.randint(1, 6))]
            text += rng.choice([" ", "  ", "\t", ", ", ".", "\n", "! ", "\xa0"]) + " ".join(part)
        rows.append((rng.choice(["en", "fr", None, "und"]), text))
    return rows


def test_counts_and_scores_equal_brute_force(spark):
    got = check(spark, sample(random.Random(1), 400))
    assert {r[0] for r in got} >= {"en", "fr", "und"} and len(got) > 60


def test_many_small_shards(spark, monkeypatch):
    monkeypatch.setattr(C, "SHARD_BYTES", 300)
    check(spark, sample(random.Random(2), 150), least=3, parts=2)


def test_phrases_are_added_up_in_steps(spark, monkeypatch):
    monkeypatch.setattr(C, "SHARD_BYTES", 300)
    monkeypatch.setattr(C, "ADD_ROWS", 2)
    monkeypatch.setattr(C, "blocks_of", lambda shards: 2)
    check(spark, sample(random.Random(5), 150), least=3, parts=2)


def test_edges(spark):
    rows = [(None, None), ("en", ""), ("en", " \t\n.;"), ("en", "one"), ("de", "a a a a a a a a"), (None, "x y " * 9), ("und", "x y"),
            ("fr", "q r s t u v " * 4000)]
    check(spark, rows, least=2, top=7)
    none = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(none).count() == 0
    assert C.collocations(spark.createDataFrame([("en", "a b")], "lang string, text string")).count() == 0


def test_exact_arithmetic_beyond_64_bits(spark):
    big = 3 * 10**12
    frequent = spark.createDataFrame(
        [("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 7)], "lang string, phrase string, k int, f long"
    )
    totals = spark.createDataFrame([("en", 10**13 + 1)], "lang string, n long")
    row = C.scored(frequent, totals).first()
    assert row.score == 1000 * (big - 7) * (10**13 + 1) // (big * (big - 1))


def test_index_counts_patterns_in_both_directions():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.r_[0, rng.integers(1, 5, rng.integers(1, 9))] for _ in range(60)] + [np.zeros(1, int)])
    index, p = TwoWayIndex.of(text, 5), None
    for k, grow in enumerate(["single", "extend_right", "extend_left", "extend_left", "extend_right"], 1):
        p = index.single() if p is None else getattr(index, grow)(p)
        want = Counter(tuple(text[i : i + k]) for i in range(len(text) - k + 1) if 0 not in text[i : i + k])
        assert {tuple(int(w[i]) for w in p.words): int(p.size[i]) for i in range(len(p.size))} == want


def test_extending_an_index_takes_little_beside_what_it_gives():
    rng = np.random.default_rng(4)
    text = np.r_[0, rng.zipf(1.3, 600_000) % 20_000, 0]
    index = TwoWayIndex.of(text, 20_000)
    single = index.single()
    tracemalloc.start()
    pairs = index.extend_right(single)
    triples = index.extend_left(pairs)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # Patterns of three numbers count each place that has no 0 within.
    assert int(triples.size.sum()) <= len(text) and len(triples.size) > 100_000
    assert most < 60 * len(text)
