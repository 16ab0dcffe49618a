"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

A source with ``n`` documents that shall fill the share ``w / sum(w)`` of
``total`` output documents has the mean repetition rate
``rate = total * w / sum(w) / n``. Each document draws its number of copies from
a Poisson distribution with that mean: a uniform number, taken from a digest of
the seed and the document, is inverted through the distribution function. The
document is exploded by that number and the copies are shuffled globally, in the
order of a second digest. Documents with more than ``BLOCK`` copies are first dealt out
over the tasks in blocks of copies, so no task unrolls a whole small source. No state, no order of rows and no generator is
involved, so a lost task repeats its draws exactly.

Defined results:

* null source: a source of its own; it is in ``weights`` under ``None``;
* source missing in ``weights``, or weight 0: no copies;
* null ``doc_id`` or text: part of the digest as an empty value;
* repeated rows draw the same number and each of them is copied that often;
* empty text: copied like any other; empty table: empty result;
* other columns are carried unchanged, unless they bear a result column's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kohorta.operators.skew import salted_join
from kohorta.session import cut_lineage

MADE = ("copy", "order_key")
BLOCK = 1024


def uniform(digest: Column) -> Column:
    """Number in [0, 1) from the first 52 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source.cast("string")))


def repetition_rates(keyed: DataFrame, weights: dict | None, total: float | None) -> DataFrame:
    """``(__source, __rate)``: one row per source of ``keyed`` that gets documents."""
    spark = keyed.sparkSession
    sizes = keyed.groupBy("__source").agg(F.count("*").alias("__n"))
    if weights is None:
        sizes = sizes.withColumn("__w", F.lit(1.0))
    else:
        rows = [("n" if k is None else f"s{k}", float(w)) for k, w in weights.items() if w > 0]
        given = spark.createDataFrame(rows, "__source string, __w double")
        sizes = sizes.join(given, "__source")
    sizes = cut_lineage(sizes, "mixing-sizes")
    whole = sizes.agg(F.sum("__w").alias("w"), F.sum("__n").alias("n")).first()
    budget = float(total if total is not None else whole["n"] or 0)
    share = F.col("__w") / F.lit(float(whole["w"] or 1.0))
    return sizes.select("__source", (F.lit(budget) * share / F.col("__n")).alias("__rate"))


def distribution(rates: DataFrame) -> DataFrame:
    """``(__source, __low, __cdf)``: distribution function of each source from ``__low`` upwards.

    The table covers 12 standard deviations and 30 around the rate, beyond which less than
    1e-30 lies on either side, so its length grows with the root of the rate. Terms are
    summed as logarithms, so a high rate does not underflow; the first is Stirling's series.
    """
    rate, low, k = F.col("__rate"), F.col("__low"), F.col("__k")
    reach = 12 * F.sqrt(rate) + 30
    up = Window.partitionBy("__source").orderBy("__k")
    at = low.cast("double")
    first = F.when(low == 0, -rate).otherwise(
        at * F.ln(rate / at) + (at - rate) - 0.5 * F.ln(2 * F.pi() * at) - 1 / (12 * at) + 1 / (360 * at * at * at)
    )
    step = F.when(k == low, first).otherwise(F.ln(rate) - F.ln(F.greatest(k, F.lit(1)).cast("double")))
    return (
        rates.withColumn("__low", F.greatest(F.floor(rate - reach).cast("bigint"), F.lit(0).cast("bigint")))
        .withColumn("__k", F.explode(F.sequence(low, F.ceil(rate + reach).cast("bigint"))))
        .withColumn("__p", F.exp(F.sum(step).over(up)))
        .withColumn("__c", F.sum("__p").over(up))
        .groupBy("__source", "__low")
        .agg(F.sort_array(F.collect_list(F.struct("__k", "__c"))).alias("__cdf"))
        .select("__source", "__low", F.col("__cdf.__c").alias("__cdf"))
    )


def unroll(counted: DataFrame) -> DataFrame:
    """Rows of ``counted`` as often as ``__copies`` (bigint) says, with ``copy`` from 1.

    Blocks go to a given number of partitions, as their size before they are unrolled
    says nothing of their size after it.
    """
    one, block = F.lit(1).cast("bigint"), F.lit(BLOCK).cast("bigint")
    rest = [c for c in counted.columns if c != "__copies"]
    few = counted.filter((F.col("__copies") > 0) & (F.col("__copies") <= BLOCK)).select(
        *rest, F.explode(F.sequence(one, F.col("__copies"))).alias("copy")
    )
    tasks = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = (
        counted.filter(F.col("__copies") > BLOCK)
        .withColumn("__from", F.explode(F.sequence(one, F.col("__copies"), block)))
        .repartition(tasks, "__id", "__from")
        .select(*rest, F.explode(F.sequence("__from", F.least("__copies", F.col("__from") + BLOCK - 1))).alias("copy"))
    )
    return few.unionAll(many)


def mix_sources(
    docs: DataFrame,
    weights: dict | None = None,
    total: float | None = None,
    seed: str = "mix-0",
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Copies of ``docs`` in shuffled order, with ``copy`` (from 1) and ``order_key``.

    ``weights`` maps sources to target weights (default: equal for all), ``total``
    is the expected number of output rows (default: as many as ``docs`` has). A hot
    source is split by ``salted_join``; the table of sources is written first, so
    Spark broadcasts it only if its size in bytes allows.

    Copies are hashed to partitions by ``order_key`` and sorted by it inside:
    partitions in turn are a uniform random order of all rows.
    """
    rest = [c for c in docs.columns if c.lower() not in MADE]
    identity = F.concat_ws(
        "|",
        F.lit(seed),
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
        F.md5(F.coalesce(F.col(text), F.lit(""))),
    )
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__doc"),
        _source_key(F.col(source)).alias("__source"),
        identity.alias("__id"),
    )
    rates = repetition_rates(keyed.select("__source"), weights, total)
    table = cut_lineage(distribution(rates), "mixing-table")
    draw = uniform(F.md5("__id"))
    copies = F.size(F.filter("__cdf", lambda c: c <= F.col("__u"))).cast("bigint") + F.col("__low")
    counted = (
        salted_join(keyed.withColumn("__u", draw), table, "__source")
        .select("__doc", "__id", copies.alias("__copies"))
    )
    return (
        unroll(counted)
        .select(
            "__doc", "copy", F.md5(F.concat_ws("|", "__id", F.lit("order"), "copy")).alias("order_key")
        )
        .repartition("order_key")
        .sortWithinPartitions("order_key", "copy")
        .select(*[F.col("__doc").getField(c).alias(c) for c in rest], "copy", "order_key")
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Pipeline stage: the mixed rows with the columns of ``docs`` alone."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    where = {k: names[docs.columns.index(k)] for k in ("source", "doc_id", "text")}
    mixed = mix_sources(docs.toDF(*names), **where, **options)
    return mixed.select(*names).toDF(*docs.columns)


def query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return mix_sources(docs).select(
        "doc_id", "text", "lang", "source", "n_chars", "copy", "order_key"
    )


def mixing_sql(docs: str, seed: str = "mix-0") -> str:
    """DuckDB SQL for ``mix_sources`` with default weights over the relation ``docs``."""
    return f"""
WITH d AS (
  SELECT *, '{seed}' || '|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS mix_id
  FROM {docs}),
sizes AS (SELECT source, count(*) AS n FROM d GROUP BY source),
rates AS (
  SELECT source, (SELECT sum(n) FROM sizes)::DOUBLE
    * (1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE) / n AS rate
  FROM sizes),
terms AS (
  SELECT source, rate, low, unnest(range(low, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k
  FROM (SELECT *, greatest(floor(rate - 12 * sqrt(rate) - 30)::BIGINT, 0) AS low FROM rates)),
logs AS (
  SELECT source, low, k, exp(sum(CASE WHEN k > low THEN ln(rate) - ln(k::DOUBLE) WHEN low = 0 THEN -rate
    ELSE low * ln(rate / low) + (low - rate) - 0.5::DOUBLE * ln(2 * pi() * low) - 1 / (12 * low::DOUBLE)
      + 1 / (360 * low::DOUBLE * low * low) END)
    OVER (PARTITION BY source ORDER BY k)) AS p
  FROM terms),
cdf AS (
  SELECT source, low, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM logs),
tables AS (SELECT source, low, list(c ORDER BY k) AS cs FROM cdf GROUP BY source, low),
drawn AS (
  SELECT d.*, t.low + len(list_filter(t.cs, lambda c: c <= ('0x' || substr(md5(d.mix_id), 1, 13))::BIGINT
    / 4503599627370496.0::DOUBLE)) AS copies
  FROM d JOIN tables t ON t.source IS NOT DISTINCT FROM d.source),
mixed AS (SELECT *, unnest(range(1, copies + 1))::BIGINT AS copy FROM drawn)
SELECT doc_id, text, lang, source, n_chars, copy,
  md5(mix_id || '|order|' || copy::VARCHAR) AS order_key
FROM mixed
"""


SQL = mixing_sql("documents")
