"""Joins and rankings that hold up when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_SALTS = 256
JOIN_SALTS = 8


def _salt(salts: int) -> Column:
    """Input partition number modulo ``salts``.

    All rows of a map task share a salt, so cutting before the shuffle loses none
    of its strength, and copies of one row in many tasks still part.
    """
    return F.spark_partition_id() % salts


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key in ``order`` (which must be total), exactly.

    Two rounds. The first ranks inside (key, salt): Spark takes the cut-off in
    every map task before the shuffle (window group limit), and a hot key spreads
    over ``RANK_SALTS`` reducers. The second ranks the survivors, at most
    ``RANK_SALTS * n`` per key. A row among the first ``n`` of its key is among
    the first ``n`` of its salt, so nothing is lost.
    """
    near = Window.partitionBy(*keys, "_salt").orderBy(*order)
    far = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", _salt(RANK_SALTS))
        .withColumn("_near", F.row_number().over(near))
        .filter(F.col("_near") <= n)
        .drop("_salt", "_near")
        .withColumn("rank", F.row_number().over(far))
        .filter(F.col("rank") <= n)
    )


def salted_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner", broadcast: bool = True) -> DataFrame:
    """Join many rows to at most a few facts per key.

    Each fact is repeated once per salt and each row meets one copy. That splits a
    hot key ``JOIN_SALTS`` ways by itself. It also puts an exchange under both
    sides: facts made by an aggregation on ``key`` arrive partitioned, and the
    adaptive skew join leaves a side without its own exchange alone. Few facts are
    broadcast instead, which Spark decides by their size; that leaves the copies out,
    so facts that grow with the input go without ``broadcast``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the rows must be the preserved side")
    salts = F.array(*[F.lit(i) for i in range(JOIN_SALTS)])
    copies = facts.withColumn("_salt", F.explode(salts))
    if not broadcast:
        copies = copies.hint("merge")
    return rows.withColumn("_salt", _salt(JOIN_SALTS)).join(copies, [key, "_salt"], how).drop("_salt")
