"""Every core query against its SQL twin, and the others for running at all."""

import pytest

from tests.compare import rows_of, sql_rows
from windrow.plans import registry

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    assert rows_of(QUERIES[name](spark, sf)) == sql_rows(SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns
    df.count()


def test_names_and_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
