from collections import Counter

import duckdb

import corpus_pipeline
from kohorta.llm import mixing
from kohorta.session import cut_lineage
from llm.test_decontaminate import slow_pairs
from llm.test_jaccard import slow_rows
from llm.test_quality import slow_statistics
from llm.test_tokens import expected


def rows(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def test_each_stage_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(cut_lineage(stage(spark, tables[-1], small)))
    raw, good, single, clean, mixed, stored = tables
    assert all(t.columns == docs.columns for t in tables[:-1])

    failed = {d for d, t in rows(raw) if (s := slow_statistics(t))[0] < 20 or 100 * s[4] > 30 * s[0]}
    kept = {d for d, _ in rows(good)}
    assert kept <= {d for d, _ in rows(raw)} - failed
    bad = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").filter("quality = 0").collect()}
    assert len(kept - bad) > 0.95 * len({d for d, _ in rows(raw)} - failed - bad)

    assert {d for d, _ in rows(single)} == {r[2] for r in slow_rows(rows(good), 5, 80)}
    assert single.count() == single.select("doc_id").distinct().count()

    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {d for d, *_ in slow_pairs(rows(single), items)}
    assert {d for d, _ in rows(clean)} == {d for d, _ in rows(single)} - leaks

    base = duckdb.connect()
    base.register("clean", clean.toPandas())
    want = base.execute(f"SELECT doc_id, text FROM ({mixing.mixing_sql('clean')})").fetchall()
    assert Counter(rows(mixed)) == Counter(want) and len(want) > 0

    got = sorted((tuple(r) for r in stored.collect()), key=lambda r: r[1])
    assert got == expected(sorted(rows(mixed)))


def test_run_equals_stages(spark, small):
    assert corpus_pipeline.run(spark, small).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_stages_take_clashing_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    docs = docs.selectExpr("*", "1 AS copy", "2 AS node", "3 AS __doc", "'a' AS kept")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        docs = cut_lineage(out)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0
