"""The queries against their SQL twins, or for running at all."""

import pytest

from tests.compare import rows_of, sql_rows
from windrow.llm import queries as q

SQL, QUERIES = q.oracle_sql(), q.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    assert rows_of(QUERIES[name](spark, sf)) == sql_rows(SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    QUERIES[name](spark, sf).count()
