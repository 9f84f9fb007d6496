"""Every query against its DuckDB text."""

import pytest

from inkstream.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(name, same):
    same(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_points(spark, sf):
    import __spark_entry__ as e

    queries = e.queries()
    assert set(e.oracle_sql()) <= set(queries)
    assert set(catalog.QUERIES) <= set(queries)
    assert e.entry(spark).count() == 28
