"""Every registered query against its SQL; those without SQL must run and keep their schema."""

import pytest
from conftest import SF, rows_of

from mailquarry.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        wanted = duck.sql(SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows_of(found) == rows_of(wanted)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)
