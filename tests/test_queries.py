"""Every query against its SQL; those without SQL must run and have unique columns."""

import pytest
from compare import DATA, connect, same

from cartloom.plans import catalogue


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    if name in catalogue.SQL:
        same(df, con, catalogue.SQL[name])
    else:
        df.collect()


def test_sql_has_queries():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_entry_needs_no_optional_part(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
