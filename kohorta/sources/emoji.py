"""Names of emoji from a public table of the Unicode consortium."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of ``emoji-test.txt``: code points; status # sign Eversion name
LINE = r"^([0-9A-F]+)(?: FE0F)?\s*;\s*[a-z-]+\s*#\s*\S+\s+E([0-9]+)\.([0-9]+)\s+(.+?)\s*$"
#: More rows than any version of the table has; a file with more is something else.
MOST = 10_000


def emoji_table(spark: SparkSession, path: str, version: float | None = None) -> DataFrame:
    """``sign, name, version`` of the single signs in a table ``emoji-test.txt``.

    A sign with a variation selector counts as the sign alone. Blanks of a name become
    ``_`` and its quotes go. Signs that are newer than ``version`` are left out.
    """
    part = [F.regexp_extract("value", LINE, i) for i in range(1, 5)]
    point = F.conv(part[0], 16, 10).cast("int")
    sign = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    rows = (
        spark.read.text(path)
        .filter(F.col("value").rlike(LINE))
        .select(
            sign.alias("sign"),
            F.regexp_replace(F.regexp_replace(part[3], "[“”]", ""), r"\s+", "_").alias("name"),
            F.concat(part[1], F.lit("."), part[2]).cast("double").alias("version"),
        )
        .groupBy("sign")
        .agg(F.max("name").alias("name"), F.min("version").alias("version"))
    )
    return rows if version is None else rows.filter(F.col("version") <= version)


def read_emoji_names(spark: SparkSession, path: str, version: float | None = None) -> dict[str, str]:
    """Names by sign, for ``normalize_post(text, names)`` and ``emoji_names(names)``."""
    rows = emoji_table(spark, path, version).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"{path} holds more signs than a table of emoji has")
    return {r["sign"]: r["name"] for r in rows}
