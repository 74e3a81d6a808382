"""Every query with SQL gives what DuckDB gives on the same tables."""

import datetime
import math

import duckdb
import pytest

from stratalog import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(([plain(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    ran = duck.execute(queries.ORACLES[name])
    assert got == bag([d[0] for d in ran.description], ran.fetchall())
    assert got[1]


def test_all_queries_have_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)
