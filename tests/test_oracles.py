"""Every registered query against its SQL twin; those without one must return rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import check, duck

QUERIES, SQLS = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, folder, name):
    assert check(spark, con, folder, name, QUERIES[name], SQLS.get(name)) == []


def test_sql_only_for_registered_queries():
    assert set(SQLS) <= set(QUERIES)


def test_entry_is_the_profile(spark):
    rows = entry(spark).collect()
    assert {r["feature"] for r in rows} >= {"l_quantity", "l_returnflag"}
