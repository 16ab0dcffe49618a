import math
from collections import Counter

import duckdb
import numpy as np

from kohorta.llm import mixing as M


def frame(spark, n=3000):
    rows = [(i, f"t{i}", "big" if i % 3 else f"s{i % 4}", i % 7) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")


def test_shares_follow_the_targets(spark):
    docs = frame(spark)
    got = Counter(r.source for r in M.mix_sources(docs, {"big": 1, "s0": 2, "s1": 1}, total=20_000).collect())
    assert set(got) == {"big", "s0", "s1"}
    for source, share in (("big", 0.25), ("s0", 0.5), ("s1", 0.25)):
        assert abs(got[source] - 20_000 * share) < 6 * math.sqrt(20_000 * share)


def test_counts_invert_the_poisson_distribution(spark):
    docs = frame(spark, 400).withColumn("copy", M.F.lit(0))
    got = Counter(r.doc_id for r in M.mix_sources(docs, {"s0": 1.0}, total=900.0).collect())
    chosen = [r.doc_id for r in docs.filter("source = 's0'").collect()]
    rate = 900.0 / len(chosen)
    import hashlib

    for i in chosen:
        inner = hashlib.md5(f"t{i}".encode()).hexdigest()
        u = int(hashlib.md5(f"mix-0|{i}|{inner}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        assert got[i] == k


def test_high_rate_does_not_underflow(spark):
    docs = spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string")
    assert 4_500 < M.mix_sources(docs, {"a": 1.0}, total=5_000).count() < 5_500


def test_tables_of_high_rates_are_right_and_short(spark):
    rates = spark.createDataFrame([("a", 3.5), ("b", 400.0), ("c", 1e6)], "__source string, __rate double")
    for r in M.distribution(rates).join(rates, "__source").collect():
        assert len(r["__cdf"]) < 24 * math.sqrt(r["__rate"]) + 64 and abs(r["__cdf"][-1] - 1) < 1e-6
        total = 0.0
        for k, c in enumerate(r["__cdf"][: 20_000 if r["__rate"] > 1e5 else None], r["__low"]):
            total += math.exp(-r["__rate"] + k * math.log(r["__rate"]) - math.lgamma(k + 1))
            assert abs(c - total) < 1e-6


def test_copies_of_one_document_are_dealt_out(spark):
    docs = spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string")
    counted = docs.selectExpr("doc_id AS __id", "100000L AS __copies")
    out = M.unroll(counted)
    assert sorted(r["copy"] for r in out.collect()) == list(range(1, 100_001))
    each = out.groupBy(M.F.spark_partition_id().alias("p")).count().collect()
    assert len(each) > 4 and max(r["count"] for r in each) < 40_000
    mixed = M.mix_sources(docs, {"a": 1.0}, total=3_000_000)
    row = mixed.agg(M.F.count("*").alias("n"), M.F.max("copy").alias("m"), M.F.countDistinct("copy").alias("d")).first()
    assert abs(row.n - 3_000_000) < 6 * math.sqrt(3_000_000) and row.n == row.m == row.d


def test_high_rates_equal_the_sql(spark):
    rows = [(i, f"t{i}", "big") for i in range(3_000)] + [(9_000 + i, f"s{i}", "small") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.withColumn("lang", M.F.lit("x")).withColumn("n_chars", M.F.lit(1))
    base = duckdb.connect()
    base.register("d", docs.toPandas())
    want = base.execute(f"SELECT doc_id, text, source, copy, order_key FROM ({M.mixing_sql('d')})").fetchall()
    ours = M.mix_sources(docs).select("doc_id", "text", "source", "copy", "order_key").collect()
    assert Counter(map(tuple, ours)) == Counter(want)


def test_edges(spark):
    rows = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, None, "a"), (3, "x", None)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, order_key int")
    got = [tuple(r) for r in M.mix_sources(docs, total=400).select("doc_id", "text", "source").collect()]
    counts = Counter(got)
    assert set(counts) == set(rows) and counts[(1, "", "a")] % 2 == 0
    assert M.mix_sources(docs.limit(0)).count() == 0
    assert M.mix_documents(docs).columns == docs.columns
    base = duckdb.connect()
    plain = docs.drop("order_key").withColumn("lang", M.F.lit("x")).withColumn("n_chars", M.F.lit(1))
    base.register("d", plain.toPandas().astype({"doc_id": "Int64"}))
    want = base.execute(f"SELECT doc_id, text, source, copy, order_key FROM ({M.mixing_sql('d')})").fetchall()
    ours = M.mix_sources(plain).select("doc_id", "text", "source", "copy", "order_key").collect()
    assert Counter(map(tuple, ours)) == Counter(want)


def test_order_is_a_shuffle(spark):
    keys = [r.order_key for r in M.mix_sources(frame(spark)).select("order_key").collect()]
    assert len(set(keys)) == len(keys)
    ids = np.array([r.doc_id for r in M.mix_sources(frame(spark)).collect()])
    assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.1
