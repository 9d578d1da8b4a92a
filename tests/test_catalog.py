"""Every registered query against its SQL, at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, oracle

SQL = oracle_sql()
NAMES = sorted(queries())


@pytest.fixture(scope="module")
def duck(folder):
    return oracle(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folder, duck, name):
    verdict, note, _ = compare(spark, duck, folder, name, queries()[name], SQL.get(name))
    assert verdict in ("ok", "rows") and not note.startswith("0 rows"), note


def test_entry(spark):
    assert entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(NAMES)
