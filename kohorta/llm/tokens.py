"""Token ids in byte planes: encode, store, index and read back.

Documents are sorted by id over all partitions, encoded, and their ids cut into
blocks of ``BLOCK_IDS``. A block is transposed into byte planes (all lowest bytes,
then all second bytes, ...), each plane is compressed with zstandard, and the
planes with a small header form one chunk:

    b"KBP1"  ids in the block (u32)  planes (u8)  size of each plane (u32 each)
    planes, lowest byte first                    all numbers little-endian

Chunks are written by Spark's own writer into ``<folder>/chunks`` (one row per
chunk, in shard order), so a store that only Spark reaches will do, and a lost
task leaves no half file. ``<folder>/index`` has a row per chunk: its place in
the whole id sequence, its number of ids and its size. A shard is one partition
of the sorted documents.

Defined results:

* null or empty text: the end id alone;
* null ``doc_id``: before all others; equal ids: in the order of a digest of the text,
  then of the text, each row with ids of its own;
* texts of any length: an id sequence may run over many chunks;
* an empty table: no chunks, an empty index, no rows;
* other columns are not stored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kohorta.llm.frames import arrow_limits
from kohorta.session import scratch_path

BLOCK_IDS, END_ID, MAGIC = 1 << 16, 1, b"KBP1"
BATCH_CHARS, CACHED_WORDS, LONGEST_CACHED = 1 << 22, 500_000, 64
WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def pack_block(ids: np.ndarray) -> bytes:
    """One chunk of the ids (unsigned 32-bit)."""
    planes = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    squeeze = zstandard.ZstdCompressor(level=1).compress
    packed = [squeeze(np.ascontiguousarray(plane).tobytes()) for plane in planes]
    sizes = struct.pack(f"<{len(packed)}I", *map(len, packed))
    return MAGIC + struct.pack("<IB", len(ids), len(packed)) + sizes + b"".join(packed)


def unpack_block(chunk: bytes) -> np.ndarray:
    """Ids of a chunk."""
    if chunk[:4] != MAGIC:
        raise ValueError("not a chunk of token ids")
    n, planes = struct.unpack_from("<IB", chunk, 4)
    sizes = struct.unpack_from(f"<{planes}I", chunk, 9)
    at, out = 9 + 4 * planes, np.zeros((n, 4), np.uint8)
    expand = zstandard.ZstdDecompressor().decompress
    for k, size in enumerate(sizes):
        out[:, k] = np.frombuffer(expand(chunk[at : at + size], max_output_size=n), np.uint8)
        at += size
    return out.reshape(-1).view("<u4")


# How word tokenizers of this kind split a normalised text.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts whose normalised pieces need no Unicode tables: ASCII and Latin-1 letters.
PLAIN = bytes(c for c in range(256) if c < 128 or (c >= 192 and c not in (215, 247)))
SPACE, LETTER, DIGIT, SIGN = range(4)
#: Kind of each lower-case character of ``PLAIN``.
KINDS = np.full(256, SIGN, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = SPACE
KINDS[[c for c in range(223, 256) if c != 247]] = LETTER
KINDS[97:123], KINDS[48:58] = LETTER, DIGIT
#: What an apostrophe takes along: one letter, or two.
ONE_LETTER, TWO_LETTERS = b"stmd", [b"re", b"ve", b"ll"]


def plain_pieces(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of ``SPLIT_PATTERN`` start in a lower-case text of ``PLAIN``, and their sizes."""
    data = np.frombuffer(text, np.uint8)
    kind = KINDS[data]
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    marks = np.flatnonzero(new & (data == ord("'")))
    if len(marks):
        after = np.r_[data, np.zeros(3, np.uint8)]
        one, two = after[marks + 1], after[marks + 2]
        size = np.isin(one, list(ONE_LETTER)).astype(np.int64)
        for a, b in TWO_LETTERS:
            size[(one == a) & (two == b)] = 2
        marks, size = marks[size > 0], size[size > 0]
        new[marks + 1] = False
        rest = marks + 1 + size
        rest = rest[rest < len(data)]
        new[rest] = True
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(data)])
    word = kind[starts] != SPACE
    return starts[word], sizes[word]


def splits_at_spaces(spec: dict) -> bool:
    """True if ids of a text are those of its pieces, one after the other.

    So it is where normalising works on single characters or collapses spaces, the
    text is then split by ``SPLIT_PATTERN``, and each piece ends with a marked token.
    """
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    norms = norm.get("normalizers", [norm] if norm else [])
    steps = pre.get("pretokenizers", [pre] if pre else [])
    plain = all(
        x["type"] in ("NFC", "Lowercase")
        or (x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " ")
        for x in norms
    )
    lowers = any(x["type"] == "Lowercase" for x in norms)
    first = steps[0] if steps else {}
    known = first.get("pattern") == {"Regex": SPLIT_PATTERN}
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    bare = not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
    marked = spec["model"].get("end_of_word_suffix") == "</w>"
    return bool(plain and lowers and known and drops and bare and marked)


def is_plain(text: str) -> bool:
    """True if all characters of the text are in ``PLAIN``."""
    try:
        return not text.encode("latin-1").translate(None, PLAIN)
    except UnicodeEncodeError:
        return False


def _as_bytes(column: pa.LargeBinaryArray) -> list[bytes]:
    """Values of a column without nulls."""
    _, offsets, data = column.buffers()
    data = data.to_pybytes() if data is not None else b""
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    return [data[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


class Encoder:
    """Ids of texts as little-endian bytes, by the tokenizers library.

    Where ``splits_at_spaces`` holds, a piece met before takes its ids from a cache of
    bounded size, and new pieces are encoded together, spaces between them; the ids
    of a piece end with a token that ends a word. Texts outside ``PLAIN`` go by their
    space-separated words, each encoded whole.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        known = json.loads(spec)
        self.split = splits_at_spaces(known)
        self.special = [t["content"] for t in known["added_tokens"]]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.split:
            self.ends[[i for t, i in known["model"]["vocab"].items() if t.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, "<u4").tobytes()

    def _new_pieces(self, pieces: list[bytes]) -> list[bytes]:
        found, at = [], 0
        while at < len(pieces):
            part = pieces[at : at + 2_000]
            text = b" ".join(part).decode("latin-1")
            encoded = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
            ids = np.array(encoded.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not end each piece with a marked token")
            raw = ids.tobytes()
            found += [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
            at += len(part)
        return found

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        """Each distinct piece is looked up once; its ids are dealt out by position."""
        text = "\n".join(texts).lower().encode("latin-1")
        starts, sizes = plain_pieces(text)
        ends = np.cumsum(sizes)
        kept = KINDS[np.frombuffer(text, np.uint8)] != SPACE
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(sizes),
            [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(np.frombuffer(text, np.uint8)[kept])],
        ).dictionary_encode()
        used, which = _as_bytes(pieces.dictionary), pieces.indices.to_numpy()
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        found = list(map(self.cache.get, used))
        unknown = [i for i, own in enumerate(found) if own is None]
        new = [used[i] for i in unknown]
        made = self._new_pieces(new)
        self.cache.update(zip(new, made, strict=True))
        for i, own in zip(unknown, made, strict=True):
            found[i] = own
        ids = np.frombuffer(b"".join(found), "<u4")
        many = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(many) - many
        many, first = many[which], first[which]
        after = np.cumsum(many)
        flat = ids[np.repeat(first - after + many, many) + np.arange(after[-1] if len(after) else 0)]
        for piece in new:
            if len(piece) > LONGEST_CACHED:
                del self.cache[piece]
        # A text's pieces are those that start before the line feed behind it.
        bounds = np.cumsum([len(t) + 1 for t in texts])
        last = np.r_[0, after][np.searchsorted(starts, bounds)].tolist()
        return [flat[i:j].tobytes() for i, j in zip([0, *last[:-1]], last, strict=True)]

    def _by_words(self, text: str) -> bytes:
        out = []
        for word in WORD.findall(text):
            ids = self.words.get(word)
            if ids is None:
                ids = self.whole(word)
                if len(word) <= LONGEST_CACHED:
                    if len(self.words) > CACHED_WORDS // 10:
                        self.words.clear()
                    self.words[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.split:
            return [self.whole(t) for t in texts]
        plain = [
            is_plain(t) and not any(s in t for s in self.special) for t in texts
        ]
        whole = [t for t, p in zip(texts, plain, strict=True) if p]
        pieces = iter(self._by_pieces(whole) if whole else [])
        return [next(pieces) if p else self._by_words(t) for t, p in zip(texts, plain, strict=True)]


_encoders: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """One encoder per worker process; its word cache outlives a task."""
    key = zlib.crc32(spec.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


PIECE = pa.struct(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("n", pa.int32())]
)
CHUNK = pa.schema(
    [
        ("shard", pa.int32()), ("chunk", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int32()),
        ("payload", pa.binary()), ("pieces", pa.list_(PIECE)),
    ]
)
CHUNK_DDL = (
    "shard int, chunk long, first long, n_ids int, payload binary, "
    "pieces array<struct<row: long, doc_id: long, piece: int, n: int>>"
)


class _Shard:
    """Blocks of one partition, filled document by document."""

    def __init__(self, shard: int):
        self.shard, self.chunk, self.first, self.row = shard, 0, 0, 0
        self.held, self.n, self.pieces, self.full = [], 0, [], []

    def add(self, doc_id, ids: np.ndarray) -> None:
        at = piece = 0
        while at < len(ids):
            take = min(len(ids) - at, BLOCK_IDS - self.n)
            self.held.append(ids[at : at + take])
            self.pieces.append({"row": self.row, "doc_id": doc_id, "piece": piece, "n": take})
            self.n, at, piece = self.n + take, at + take, piece + 1
            if self.n == BLOCK_IDS:
                self.close()
        self.row += 1

    def close(self) -> None:
        if self.n:
            payload = pack_block(np.concatenate(self.held))
            self.full.append((self.shard, self.chunk, self.first, self.n, payload, self.pieces))
            self.chunk, self.first = self.chunk + 1, self.first + self.n
            self.held, self.n, self.pieces = [], 0, []

    def batch(self) -> pa.RecordBatch:
        columns, self.full = list(zip(*self.full, strict=True)), []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, CHUNK, strict=True)], schema=CHUNK
        )


def _encode_partition(spec, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(spec.value), _Shard(TaskContext.get().partitionId())
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(keys):
                some, size = [], 0
                while at + len(some) < len(keys) and size < BATCH_CHARS:
                    some.append(texts[at + len(some)].as_py() or "")
                    size += len(some[-1])
                for key, raw in zip(keys[at : at + len(some)], encoder.encode(some), strict=True):
                    shard.add(key, np.frombuffer(raw + end, "<u4"))
                at += len(some)
                if len(shard.full) >= 4:
                    yield shard.batch()
        shard.close()
        if shard.full:
            yield shard.batch()

    return run


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int = END_ID,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode ``docs`` with the tokenizer file and write chunks and index to ``folder``.

    The range partitioning splits equal ids by a digest of the text, so many rows
    of one id do not meet in one partition. The tokenizer file, a few megabytes, is
    broadcast; executors need no local copy.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    with open(tokenizer, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    keyed = docs.select(F.col(doc_id).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    keyed = keyed.withColumn("h", F.xxhash64("t"))
    ordered = keyed.repartitionByRange(F.col("k").asc_nulls_first(), "h").sortWithinPartitions(
        F.col("k").asc_nulls_first(), "h", "t"
    )
    chunks = ordered.select("k", "t").mapInArrow(_encode_partition(spec, end_id), CHUNK_DDL)
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    stored = spark.read.schema(CHUNK_DDL).parquet(f"{folder}/chunks")
    shards = stored.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    (
        stored.select("shard", "chunk", "first", "n_ids", F.length("payload").alias("n_bytes"))
        .join(bases, "shard")
        .select("shard", "chunk", (F.col("base") + F.col("first")).alias("start"), "n_ids", "n_bytes")
        .write.mode("overwrite")
        .parquet(f"{folder}/index")
    )


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, bits reflected."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc_join(left: int, right: int, right_bytes: int) -> int:
    """crc32 of two strings in a row from the crc32 of each."""
    shift, power, n = 1 << 31, 1 << 23, right_bytes
    while n:
        if n & 1:
            shift = _times(shift, power)
        power, n = _times(power, power), n >> 1
    return _times(shift, left) ^ right


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["shard", "row", "doc_id", "piece", "at", "n", "crc"]
    for batch in batches:
        shard, first, payloads, lists = batch.columns
        pieces, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        n = pieces.field("n").to_numpy().astype(np.int64)
        before = np.cumsum(n) - n
        heads = np.r_[0, np.cumsum(sizes)]
        at = before - np.repeat(np.r_[before, 0][heads[:-1]], sizes)
        crcs = []
        for k, payload in enumerate(payloads):
            ids = memoryview(unpack_block(payload.as_py())).cast("B")
            inside = slice(heads[k], heads[k + 1])
            for i, size in zip(at[inside].tolist(), n[inside].tolist(), strict=True):
                crcs.append(zlib.crc32(ids[4 * i : 4 * (i + size)]))
        columns = [
            pa.array(np.repeat(shard.to_numpy(), sizes)), pieces.field("row"), pieces.field("doc_id"),
            pieces.field("piece"), pa.array(at + np.repeat(first.to_numpy(), sizes)), pa.array(n),
            pa.array(crcs, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for pieces in batch.column(4).to_pylist():
            crc = pieces[0]["crc"]
            for p in pieces[1:]:
                crc = crc_join(crc, p["crc"], 4 * p["n"])
            out.append(crc)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(out, pa.int64())],
            names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
        )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a written folder, from its chunks: ``doc_id, start, n_tokens, ids_crc32``.

    A document's pieces are digested where their chunk lies; only the digests of a
    document meet, and the digest of the whole follows from them.
    """
    arrow_limits(spark)
    chunks = spark.read.schema(CHUNK_DDL).parquet(f"{folder}/chunks")
    pieces = chunks.select("shard", "first", "payload", "pieces").mapInArrow(
        _read_chunks,
        "shard int, row long, doc_id long, piece int, at long, n long, crc long",
    )
    whole = (
        pieces.groupBy("shard", "row", "doc_id")
        .agg(
            F.min("at").alias("at"),
            F.sum("n").alias("n_tokens"),
            F.sort_array(F.collect_list(F.struct("piece", "n", "crc"))).alias("pieces"),
        )
        .select("shard", "doc_id", "at", "n_tokens", "pieces")
        .mapInArrow(_join_pieces, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    )
    index = spark.read.schema("shard int, chunk long, start long, n_ids int, n_bytes int")
    bases = index.parquet(f"{folder}/index").filter("chunk = 0").select("shard", F.col("start").alias("base"))
    return whole.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_table(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to a new folder of the shared scratch space and read it back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder = scratch_path(spark, "tokens")
    write_tokens(docs, tokenizer, folder)
    return read_tokens(spark, folder)


def query(spark, folder):
    return token_table(spark, spark.read.parquet(f"{folder}/documents.parquet"))
