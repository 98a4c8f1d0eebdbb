"""Every query with a SQL twin gives the twin's rows at the smallest size."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, EVERY_SQL = entry.queries(), entry.oracle_sql()
#: The text operators' twins are tested with these.
SQL = {n: q for n, q in EVERY_SQL.items() if not n.startswith("op") and n != "pipeline"}


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return int(v) if hasattr(v, "item") and not isinstance(v, float) else v


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(str(cell(v)) for v in r) for r in frame[names].itertuples(index=False)))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf, duck, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if not n.startswith("op") and n != "pipeline"))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))


def test_entry(spark):
    assert entry.entry(spark).count() == 1
