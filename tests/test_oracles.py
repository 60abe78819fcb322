"""Every registered query against its DuckDB SQL on the smallest tables; those without SQL have to run."""

import os

import duckdb
import pytest

from timeloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    if name not in registry.ORACLES:
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
