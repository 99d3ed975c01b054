"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from oracle import connect, difference
from tidecase.plans import QUERIES

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = entry.queries()[name](spark, data)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_only_the_unordered_sample_lacks_sql():
    assert set(QUERIES) - set(ORACLES) == {"limit_n"}
