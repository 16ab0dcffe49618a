import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from kohorta.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def values(spark):
    """Evaluate one expression of column ``x`` for each given value, in order."""

    def run(expression, inputs, kind="string"):
        from pyspark.sql import functions as F

        rows = [(i, x) for i, x in enumerate(inputs)]
        df = spark.createDataFrame(rows, f"i int, x {kind}")
        return [r[1] for r in df.select("i", expression(F.col("x"))).orderBy("i").collect()]

    return run


def executed_plan(df) -> str:
    """Final physical plan of ``df`` after running it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
