"""Study settings: track keywords, concepts and thresholds from one JSON file."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The values in this file are fixed: words, concepts and thresholds of the shipped study.
DIABETES = str(Path(__file__).with_name("diabetes.json"))
SCHEMA = (
    "track array<string>, entry_keywords array<string>, key_concept string, "
    "concept_keywords map<string,string>, thresholds map<string,double>"
)


def read_settings(spark: SparkSession, path: str = DIABETES) -> DataFrame:
    """The settings file as one row. A study outside the shipped example lives on
    storage that every executor can read."""
    if path == DIABETES:
        text = Path(path).read_text(encoding="utf-8")
        raw = spark.createDataFrame([(text,)], "value string")
    else:
        raw = spark.read.text(path, wholetext=True)
    return raw.select(F.from_json("value", SCHEMA).alias("s")).select("s.*")


def load_concepts(spark: SparkSession, path: str = DIABETES) -> DataFrame:
    """``(concept, keywords)``, keywords split on comma and blank."""
    return read_settings(spark, path).select(
        F.explode("concept_keywords").alias("concept", "text")
    ).select("concept", F.split("text", ",\\s*").alias("keywords"))


def load_thresholds(spark: SparkSession, path: str = DIABETES) -> DataFrame:
    return read_settings(spark, path).select(F.explode("thresholds").alias("concept", "threshold"))


def load_track(spark: SparkSession, path: str = DIABETES) -> list[str]:
    return list(read_settings(spark, path).first()["track"])


def load_entry_keywords(spark: SparkSession, path: str = DIABETES) -> list[str]:
    return list(read_settings(spark, path).first()["entry_keywords"])
