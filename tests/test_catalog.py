"""Every registered query of the engine against its DuckDB SQL."""

import pytest

from tallyspark.plans import catalog, extra, more  # noqa: F401  these add to the catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(name, same):
    same(catalog.QUERIES[name], catalog.ORACLES[name])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
