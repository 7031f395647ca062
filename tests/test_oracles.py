"""Every registered query of the library that has SQL gives the SQL's rows."""

import pytest

from attestra.plans import registry
from tests.conftest import SF, same

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    same(spark, duck, registry.queries()[name], ORACLES[name])


def test_queries_without_sql_run(spark):
    for name, f in registry.queries().items():
        if name not in ORACLES:
            assert f(spark, SF).columns


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
