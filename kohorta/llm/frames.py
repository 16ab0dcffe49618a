"""Arrow batches of whole texts in and out of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: A batch ends after so many rows or bytes; one text is never cut.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
    # Joins that look up a part of the texts filter them before the exchange, at any size.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
}


def arrow_limits(spark) -> None:
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)


def map_texts(
    df: DataFrame,
    text: str,
    carry: list[str],
    fields: StructType,
    work: Callable[[pa.Array], list[pa.Array]],
) -> DataFrame:
    """``carry`` columns of ``df`` and the columns that ``work`` makes of each text.

    ``work`` gets the texts of a batch and returns one array per field. Carried
    columns travel under positions, so no name can clash; a made column replaces a
    carried one of its name.
    """
    arrow_limits(df.sparkSession)
    made = {f.name.lower() for f in fields}
    carry = [c for c in carry if c.lower() not in made]
    source = df.select(
        F.col(f"`{text}`").cast("string").alias("t"),
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
    )
    out = StructType(
        [StructField(f"c{i}", source.schema[f"c{i}"].dataType) for i in range(len(carry))]
        + [StructField(f"m{i}", f.dataType) for i, f in enumerate(fields)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in out]
        for batch in batches:
            if batch.num_rows:
                arrays = [batch.column(i + 1) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays(arrays + work(batch.column(0)), names=names)

    mapped = source.mapInArrow(run, out)
    return mapped.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)],
        *[F.col(f"m{i}").alias(f.name) for i, f in enumerate(fields)],
    )


def longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


TEXT = StringType()


def smallest_digests(rows: DataFrame, key: Column, limit: int) -> DataFrame:
    """At most ``limit`` rows with the smallest md5 digests of ``key``: a fixed sample.

    A count comes first, and rows whose digest lies above about twice the wanted share
    are filtered where they are read, so a task hands over few rows at any size. With
    uniform digests that keeps fewer than ``limit`` rows once in more than 10**9 runs.
    """
    marked = rows.withColumn("__digest", F.md5(key))
    share = min(1.0, (2 * limit + 200) / max(rows.count(), 1))
    bound = format(min(int(share * 16**12), 16**12 - 1), "012x") + "g"
    near = marked.filter(F.substring("__digest", 1, 12) <= bound)
    return near.orderBy("__digest", *rows.columns).limit(limit).drop("__digest")


def texts_of(
    docs: DataFrame, asked: DataFrame, row: str, doc_id: str, text: str, whole_rows: bool = False
) -> DataFrame:
    """Rows of ``asked`` with the ``text`` of their document, each once.

    With ``whole_rows`` the document comes as a struct ``row`` of all its columns instead.

    ``asked`` names a document by ``doc_id`` and ``text_hash`` and its own rows by ``row``,
    a number from 0 upwards. The comparison that always holds lets Spark build its
    runtime filter from this side, so texts nobody asks for are dropped before they are
    shuffled. Equal documents give equal rows, which meet where the join has put them.
    """
    arrow_limits(docs.sparkSession)
    keys = ["__hash", "__id", "__none"]

    def keyed(frame, digest, number, *rest):
        parts = (digest, F.coalesce(number, F.lit(0)), number.isNull())
        return frame.select(*[p.alias(k) for p, k in zip(parts, keys, strict=True)], *rest)

    whole = F.col(f"`{text}`").cast("string")
    taken = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if whole_rows else whole.alias("text")
    source = keyed(docs, F.xxhash64(whole), F.col(f"`{doc_id}`").cast("long"), taken)
    rest = [c for c in asked.columns if c not in ("doc_id", "text_hash")]
    wanted = keyed(asked.filter(f"{row} >= 0"), F.col("text_hash"), F.col("doc_id"), *rest)
    return source.join(wanted, keys).dropDuplicates([*keys, row]).drop(*keys)
