"""Every query with SQL gives the same rows in Spark and DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as contract
from check import compare
from conftest import DATA

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    base = duckdb.connect()
    for file in sorted(os.listdir(DATA)):
        base.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    return base


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    assert len(contract.entry(spark).take(5)) > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()) == "ok"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    frame = QUERIES[name](spark, DATA)
    assert frame.columns and frame.take(1)
