"""Every registered query of the library against DuckDB on the smallest tables; those without SQL must run and give rows."""

import pytest
from compare import SF, difference, duck, spark_rows, sql_rows

from tidemark.plans import registry

#: Slow fits on whole tables; the functions that they use have tests of their own.
SLOW = {"k12_grid"}


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query(spark, con, name):
    got = spark_rows(registry.queries()[name](spark, SF))
    if name in registry.oracles():
        assert difference(got, sql_rows(con, registry.oracles()[name])) == ""
    else:
        assert got[0]


def test_each_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())
