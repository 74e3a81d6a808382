"""Corpus queries against their SQL, on the given tables."""

import duckdb
import pytest

from stratalog.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(r[c] for c in names) for r in df.collect())
    ran = con.execute(queries.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(ran.description)}
    assert sorted(at) == names
    assert got == sorted(tuple(r[at[c]] for c in names) for r in ran.fetchall())
