"""Every query that has SQL, against DuckDB on the same files: column names and values."""

import glob
import math
import os

import duckdb
import pytest

from tessera.queries import ORACLE, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    result = oracle.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in sorted(names)]
    want = sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    assert columns == sorted(names)
    assert got == want
