import json
import zlib

import numpy as np
import public_tokenizers
import pytest

from kohorta.llm import tokens as T

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "one", "It's  a\ttest\nof\x0bwords\x0c\r ", "a\x1cb c\x85d e ́x é", "<|endoftext|> x<|startoftext|>y",
       "x" * 5000, "日本語 テキスト ὈΔΥΣΣΕΎΣ ς", "é ́e", "1234 #*$%&| 's 't", "ÀÉß ÿØ²³ª µ×÷ x\x00y\x1fz", "İstanbul œuvre ŒIL ΑΣ Σ", "don't we'LL 12's"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def expected(rows):
    """Rows of the result in ascending order of doc_id, ids straight from the library."""
    tokenizer, start, out = library(), 0, []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("n", [0, 1, 7, 70_000])
def test_block_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert (T.unpack_block(T.pack_block(ids)) == ids).all()


def test_crc_join():
    a, b = b"abc" * 999, b"defg" * 77_777
    assert T.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_encoder_equals_library():
    spec = open(PATH, encoding="utf-8").read()
    assert T.splits_at_spaces(json.loads(spec))
    tokenizer, encoder = library(), T.Encoder(spec)
    texts = [t or "" for t in ODD]
    whole = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == whole and encoder.encode(texts[::-1]) == whole[::-1]
    rng = np.random.default_rng(4)
    mixed = ["".join(rng.choice(list("abstrevmldSTE019 .,'!-\n\x1cÉßÿ"), 60)) for _ in range(500)]
    assert encoder.encode(mixed) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in mixed]


def test_other_tokenizer_takes_whole_texts():
    spec = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    assert not T.Encoder(spec).split


def test_round_trip_edges(spark):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(None, "no id"), (6, "tie"), (6, "tie"), (99, "long word " * 60_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, pieces string")
    got = sorted(map(tuple, T.token_table(spark, docs).collect()), key=lambda r: r[1])
    lengths = {}
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda k: -1 if k is None else k)
    for doc_id, start, n, crc in got:
        lengths.setdefault(doc_id, []).append((n, crc))
    want = {}
    for doc_id, _, n, crc in expected(rows):
        want.setdefault(doc_id, []).append((n, crc))
    assert {k: sorted(v) for k, v in lengths.items()} == {k: sorted(v) for k, v in want.items()}
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.token_table(spark, docs).count() == 0


def test_query_equals_library(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").select("doc_id", "text")
    assert sorted(map(tuple, T.query(spark, small).collect())) == expected(map(tuple, docs.collect()))


def test_plain_pieces_are_those_of_the_pattern():
    rng = np.random.default_rng(4)
    signs = [*"stmdrevlabß'ÿé .,\"12\n\t\x1c\x00÷", "'s", "'re", "'ll", "'ve", "''", "'rx", "'", "'v"]
    pattern = T.re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9ß-öø-ÿ]+")
    for _ in range(3000):
        text = "".join(rng.choice(signs, rng.integers(0, 14)))
        starts, sizes = T.plain_pieces(text.encode("latin-1"))
        assert [text[i : i + n] for i, n in zip(starts, sizes, strict=True)] == pattern.findall(text)


def test_a_piece_of_a_batch_is_looked_up_once(monkeypatch):
    asked = []
    encoder = T.Encoder(open(PATH, encoding="utf-8").read())
    monkeypatch.setattr(encoder, "_new_pieces", lambda pieces: asked.extend(pieces) or T.Encoder._new_pieces(encoder, pieces))
    texts = ["one two one", "", "two don't", "TWO one"] * 50
    want = [np.array(library().encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[:4]]
    assert encoder.encode(texts) == want * 50 and encoder.encode(texts) == want * 50
    assert sorted(asked) == [b"'t", b"don", b"one", b"two"]
