"""Queries whose feature needs the whole table, at a size where a cap on rows would show."""

import duckdb
import pytest

from tessera.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.01"


def both(spark, name):
    con = duckdb.connect()
    for t in ("customer", "events", "orders", "part"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = QUERIES[name](spark, DATA)
    result = con.execute(ORACLE[name])
    assert df.columns == [x[0] for x in result.description]
    return sorted(tuple(r) for r in df.collect()), sorted(result.fetchall())


@pytest.mark.parametrize(("name", "t", "last"), [("order_nulls_last", "orders", None), ("enum_order", "customer", "HOUSEHOLD"), ("types_wide_order", "events", "-50")])
def test_order_over_all_rows(spark, name, t, last):
    got, want = both(spark, name)
    assert got == want and len(got) == spark.read.parquet(f"{DATA}/{t}.parquet").count()
    in_order = sorted(got, key=lambda r: r[2])
    assert [r[2] for r in in_order] == list(range(1, len(got) + 1))
    assert in_order[-1][1] == last


def test_enum_min_max_over_all_events(spark):
    got, want = both(spark, "enum_min_max")
    events = spark.read.parquet(f"{DATA}/events.parquet")
    assert got == want and {r[0] for r in got} == {r[0] for r in events.select("user_id").distinct().collect()}
    assert {r[2] for r in got} == {r[3] for r in got} == {"view", "click", "signup", "purchase", "error"}


def test_join_range_over_all_parts(spark):
    got, want = both(spark, "join_range")
    sizes = {r["p_partkey"]: r["p_size"] for r in spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", "p_size").collect()}
    assert got == want and len({sizes[p] for _, p in got}) > 1
