"""Every query of the library against its SQL in DuckDB."""

from __future__ import annotations

import pytest

from tests.oracle import connection, rows
from tidemark.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    def whole(f):  # pandas makes floats of integers with nulls
        return f.convert_dtypes()
    assert rows(whole(got)) == rows(whole(want))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
