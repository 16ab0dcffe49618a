"""Every registered query against its reference SQL on the smallest data set."""

import pytest
from oracle_check import connect, differences

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()
# Those of the language-model subpackage without SQL have their own tests.
NAMES = sorted(n for n in QUERIES if n in SQL or not n.startswith(("op", "pipeline")))


@pytest.fixture(scope="module")
def base(small):
    return connect(small)


def test_every_reference_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, base, name):
    frame = QUERIES[name](spark, small)
    if name in SQL:
        assert differences(frame, SQL[name], base) is None
    else:
        assert frame.count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns == [
        "user_id", "quarter", "start", "stop", "exposition", "outcome",
    ]
