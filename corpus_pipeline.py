"""Training corpus from raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``; the last returns one row per stored document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kohorta.llm import decontaminate, jaccard, mixing, quality, tokens
from kohorta.session import cut_lineage, tune


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rules and isolation forests keep."""
    return quality.keep_good(tune(spark), docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word n-grams."""
    tune(spark)
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    items = tune(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean_documents(docs, items)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many documents, with an equal share for each source, in shuffled order."""
    tune(spark)
    return mixing.mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids stored in byte planes, read back as one row per document."""
    return tokens.token_table(tune(spark), docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

#: Forests, components of links and tokenizers have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut_lineage(docs, f"pipeline-{number}")
    return docs
