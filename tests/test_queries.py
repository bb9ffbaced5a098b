"""Every query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from latticeworks import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("nation", "region", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in queries.ORACLES:
        assert len(names) == len(df.columns)
        return
    rel = sql.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == names
    place = [rel.columns.index(c) for c in names]
    want = sorted((tuple(plain(r[k]) for k in place) for r in rel.fetchall()), key=repr)
    assert got == want
