"""Translation of foreign posts by a function that the user supplies.

Each distinct text is asked for once, whatever the number of its posts and runs: answers are
kept in a stored table that the next run looks into first. A client is made once in each
task and gets a bounded number of attempts for a text. A text that fails becomes a row with
its error instead of a lost job; its posts keep their text, and the next run asks again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorta.operators.skew import salted_join

ANSWERS = "key string, lang string, text string, answer string, error string, attempts int"


def _keyed(posts: DataFrame) -> DataFrame:
    """Adds ``key``, a digest of language and text."""
    return posts.withColumn("key", F.sha2(F.concat_ws("\x1f", F.coalesce("lang", F.lit("")), "text"), 256))


def foreign_texts(posts: DataFrame, lang: str = "en") -> DataFrame:
    """``key, lang, text`` of the distinct texts in another language; no language is foreign.

    Copies are combined before the shuffle.
    """
    foreign = posts.filter(~F.col("lang").eqNullSafe(lang) & F.col("text").isNotNull())
    keyed = _keyed(foreign.select("lang", "text"))
    return keyed.groupBy("key").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows; an empty table before the first run."""
    try:
        return spark.read.schema(ANSWERS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], ANSWERS)
        raise


def ask(texts: DataFrame, make_client: Callable, attempts: int = 3) -> DataFrame:
    """Answers of ``make_client()(text, lang)`` or the last error after ``attempts`` calls."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for frame in frames:
            rows = []
            for key, lang, text in frame.itertuples(index=False):
                answer = error = None
                for used in range(1, attempts + 1):
                    try:
                        client = client or make_client()
                        answer, error = client(text, lang), None
                        break
                    except Exception as problem:  # noqa: BLE001  whatever a client raises becomes a row
                        error = f"{type(problem).__name__}: {problem}"
                rows.append((key, lang, text, answer, error, used))
            yield pd.DataFrame(rows, columns=["key", "lang", "text", "answer", "error", "attempts"])

    return texts.select("key", "lang", "text").mapInPandas(work, ANSWERS)


def translate(
    posts: DataFrame,
    make_client: Callable,
    path: str,
    lang: str = "en",
    attempts: int = 3,
    tasks: int | None = None,
) -> DataFrame:
    """``posts(id, lang, text, …)`` with foreign texts translated, answers kept at ``path``.

    ``tasks`` bounds the clients that work at a time; without it Spark decides.
    """
    spark = posts.sparkSession
    known = read_answers(spark, path).filter("error IS NULL").select("key")
    new = foreign_texts(posts, lang).join(known, "key", "left_anti")
    ask(new.repartition(tasks, "key") if tasks else new, make_client, attempts).write.mode("append").parquet(path)
    # Two runs at once may both have asked for a text; one answer is taken.
    answers = read_answers(spark, path).filter("error IS NULL").groupBy("key").agg(F.min("answer").alias("answer"))
    own = F.col("lang").eqNullSafe(lang) | F.col("text").isNull()
    foreign = salted_join(_keyed(posts.filter(~own)), answers, "key", "left")
    foreign = foreign.withColumn("text", F.coalesce("answer", "text")).select(*posts.columns)
    return posts.filter(own).unionByName(foreign)
