"""Every registered query of the engine against its DuckDB equivalent."""

import pytest

from lectern.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, same, name):
    same(QUERIES[name](spark, data), SQL[name])


def test_queries_without_sql_give_rows(spark, data):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
