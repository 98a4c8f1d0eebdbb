"""Queries of the text operators with SQL twins."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from isthmus.llm import queries as q
from test_queries import rows

SQL = q.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf, duck, name):
    assert rows(entry.queries()[name](spark, sf).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_every_operator_has_a_query():
    have = {n.split("_")[0] for n in entry.queries()}
    assert {f"op{i}" for i in range(1, 14)} | {"pipeline"} <= have and set(SQL) <= set(entry.oracle_sql())
