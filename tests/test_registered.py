"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_matches_its_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in SQL:
        problem, _ = compare(df, con, SQL[name])
        assert problem is None, problem
    else:
        assert df.count() > 0
