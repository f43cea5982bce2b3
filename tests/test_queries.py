"""Every registered query against its DuckDB SQL on the smallest given tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from colloquy.plans.oracle import oracle_sql
from colloquy.plans.queries import queries
from tools.compare import TABLES, rows_of

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()
ROWS_ONLY = {"source_inventory"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    return con


def test_every_query_has_sql_or_is_listed():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ROWS_ONLY:
        assert got
        return
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
