"""Benchmark decontamination by MinHash containment (DataFrame functions only).

A test item is short and a document may be long, so the similarity of the two sets
says little; what counts is the share of the item's shingles in the document. Items
are partitioned by the size of their shingle set. An item is represented by the ``k``
smallest hash values of its shingles (a bottom-k MinHash sketch), and ``k`` is set
per size partition: if at least ``percent`` of the shingles of an item of the
partition are in a document, fewer than ``k`` are not, so at least one value of the
sketch is found there. The sketches are searched in the shingles of all documents;
what is found is a candidate, and candidates are verified by counting all shingles of
the item in the document.

Words are runs of letters and digits of the lower-case text. Shingles are
``SHINGLE`` words; a shorter item is one shingle of all its words, searched at that
length. Items with equal shingle sets form a class named by its smallest id, so
copies of an item do not multiply pairs.

Defined results:

* null or empty text: no shingles; such an item is never found, such a document is clean;
* null ``doc_id`` and equal ids: each row is judged by its own text, and so is each item;
  rows equal in id and text give one pair. A class is named by the smallest id that is not
  null, and has none if all are null;
* a shingle that repeats inside an item or a document counts once;
* empty tables: no pairs; other columns play no part, and stay in ``clean_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.operators.skew import salted_join
from kohorta.session import cut_lineage

SHINGLE, PERCENT = 5, 80
NO_WORD = r"[^\p{L}\p{N}]+"
NO_ID = -(2**63)
#: What names a row of documents or items: its id and a digest of its text.
ROW, CLASS = ["__doc", "__digest"], ["__item", "__version"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, not once per mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(words: Column, lengths: list[int]) -> Column:
    """Hashes of all runs of words of the given lengths, one array."""

    def runs(length: int):
        def of(hashes: Column) -> Column:
            last = F.size(hashes) - length
            run = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(length)])
            none = F.array().cast("array<bigint>")
            return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), run)).otherwise(none)

        return of

    word_hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _bind(word_hashes, lambda h: F.concat(*[runs(n)(h) for n in lengths]))


def _row_key(number: Column, text: Column, names: list[str]) -> list[Column]:
    return [F.coalesce(number.cast("long"), F.lit(NO_ID)).alias(names[0]), F.xxhash64(text.cast("string")).alias(names[1])]


def item_classes(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(__item, __version, __name, __size, __hashes)``: distinct shingle sets with their smallest ids."""
    words = items.select(
        *_row_key(F.col(item_id), F.col(text), CLASS), F.col(item_id).cast("long").alias("__name"),
        words_of(F.col(text)).alias("__words"),
    )
    length = F.least(F.size("__words"), F.lit(SHINGLE))
    sets = F.when(length == SHINGLE, shingle_hashes(F.col("__words"), [SHINGLE]))
    for n in range(1, SHINGLE):
        sets = sets.when(length == n, shingle_hashes(F.col("__words"), [n]))
    return (
        words.filter(F.size("__words") > 0)
        .select(*CLASS, "__name", length.alias("__length"), F.explode(sets).alias("__hash"))
        .groupBy(*CLASS)
        .agg(
            F.sort_array(F.collect_set("__hash")).alias("__hashes"),
            F.max("__length").alias("__length"), F.min("__name").alias("__name"),
        )
        .groupBy("__hashes")
        .agg(F.min(F.struct(*CLASS)).alias("__key"), F.max("__length").alias("__length"), F.min("__name").alias("__name"))
        .select("__key.*", "__name", "__hashes", "__length", F.size("__hashes").alias("__size"))
    )


def sketch_size(size: Column, percent: int) -> Column:
    """Values in the sketch of an item, from the upper end of its size partition."""
    upper = F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double"))) + 1).cast("long") - 1
    needed = F.ceil(upper * percent / 100.0)
    return F.least(size.cast("long"), upper - needed + 1).cast("int")


def contained_rows(docs: DataFrame, items: DataFrame, percent: int, doc_id: str, text: str) -> DataFrame:
    """Row keys of documents with the classes they contain.

    Sketches and candidates are written first. Spark broadcasts them if their size
    in bytes allows, else the joins are salted, since a shingle may be in a third
    of all documents.
    """
    classes = cut_lineage(item_classes(items), "decontaminate-items")
    lengths = sorted(r[0] for r in classes.select("__length").distinct().collect()) or [SHINGLE]
    sketches = classes.select(
        *CLASS, F.explode(F.slice("__hashes", F.lit(1), sketch_size(F.col("__size"), percent))).alias("__hash")
    )
    sketches = cut_lineage(sketches, "decontaminate-sketches")
    texts = docs.select(*_row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), ROW), F.col(f"`{text}`").alias("__text"))
    exploded = texts.select(
        *ROW, F.explode(shingle_hashes(words_of(F.col("__text")), lengths)).alias("__hash")
    )
    candidates = salted_join(exploded, sketches, "__hash").select(*ROW, *CLASS).distinct()
    candidates = cut_lineage(candidates, "decontaminate-candidates")

    suspects = texts.join(candidates.select(*ROW).distinct(), ROW, "left_semi")
    shared = suspects.select(
        *ROW, F.explode(shingle_hashes(words_of(F.col("__text")), lengths)).alias("__hash")
    ).distinct()
    all_hashes = classes.select(*CLASS, "__name", "__size", F.explode("__hashes").alias("__hash"))
    return (
        salted_join(shared, all_hashes, "__hash")
        .join(candidates, [*ROW, *CLASS], "left_semi")
        .groupBy(*ROW, *CLASS)
        .agg(
            F.count("*").alias("n_shared"), F.max("__size").cast("long").alias("n_item"),
            F.max("__name").alias("item_id"),
        )
        .filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    )


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    percent: int = PERCENT,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item`` of all items contained in a document."""
    real = F.when(F.col("__doc") != NO_ID, F.col("__doc")).alias("doc_id")
    return contained_rows(docs, items, percent, doc_id, text).select(real, "item_id", "n_shared", "n_item")


def clean_documents(docs: DataFrame, items: DataFrame, percent: int = PERCENT,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose own text contains no item."""
    leaks = contained_rows(docs, items, percent, doc_id, text).select(*ROW).distinct()
    leaks = cut_lineage(leaks, "decontaminate-leaks")
    own = _row_key(docs[doc_id], docs[text], ["id", "digest"])
    return docs.join(leaks, (own[0] == leaks["__doc"]) & (own[1] == leaks["__digest"]), "left_anti")


def query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return contained_items(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def decontamination_sql(docs: str) -> str:
    """Pairs of documents of the relation ``docs`` and benchmark classes, by plain counting."""
    split = rf"list_filter(string_split_regex(lower(coalesce(text, '')), '{NO_WORD}'), lambda w: w <> '')"
    grams = "unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' ')))"
    return rf"""
WITH iw AS (SELECT item_id, {split} AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, l, {grams} AS gram FROM (
  SELECT *, least(len(w), {SHINGLE})::BIGINT AS l FROM iw WHERE len(w) > 0)),
sets AS (SELECT item_id, list(gram ORDER BY gram) AS grams FROM ig GROUP BY item_id),
classes AS (SELECT min(item_id) AS item_id, len(grams) AS n FROM sets GROUP BY grams),
dw AS (SELECT doc_id, {split} AS w FROM {docs}),
dg AS (SELECT DISTINCT doc_id, {grams} AS gram FROM (
  SELECT * FROM dw, (SELECT DISTINCT l FROM ig) WHERE len(w) >= l))
SELECT dg.doc_id, c.item_id, count(*) AS n_shared, max(c.n)::BIGINT AS n_item
FROM dg JOIN ig ON ig.gram = dg.gram JOIN classes c ON c.item_id = ig.item_id
GROUP BY dg.doc_id, c.item_id
HAVING count(*) * 100 >= max(c.n) * {PERCENT}
"""


SQL = decontamination_sql("documents")
