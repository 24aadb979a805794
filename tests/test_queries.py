"""Every registered query against its SQL; those without SQL must give rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Empty at the smallest scale: rare combinations only.
MAY_BE_EMPTY = {"aggregate_having", "unused_profiles", "blocks_of_module", "lookup_block", "op3_secrets"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    problem = compare(spark, con, name, QUERIES[name], SQL.get(name), sf)
    if problem == "no rows" and name in MAY_BE_EMPTY:
        return
    assert problem == ""


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 24 and all(0 <= r.pass_rate <= 1 for r in rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
