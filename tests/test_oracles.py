"""Every registered query with SQL gives the same rows in DuckDB; the others run and keep a stable schema."""

import pytest
from oracle_check import DATA, compare, duck

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = f"{DATA}/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    problem, rows, _, _ = compare(spark, con, SF_DIR, queries()[name], SQL.get(name))
    assert problem is None, problem
    assert rows > 0 or name in SQL


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns
