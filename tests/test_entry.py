"""The driver contract: names, schemas and a few oracles."""

import duckdb
import pytest

import __spark_entry__ as entry


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 100


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 15
    assert df.columns[:3] == ["user_id", "status", "last_fade_cycle"]


@pytest.mark.parametrize("name", ["label_build", "outlier_flags", "c_index", "review_queue", "snapshot_diff"])
@pytest.mark.parametrize("rows", ["1000000", "30"])
def test_same_result_with_split_keys(spark, sf, name, rows):
    spark.conf.set("lifecurve.chunkRows", rows)
    try:
        got = entry.queries()[name](spark, sf)
        mine = sorted(map(repr, (tuple(r) for r in got.select(sorted(got.columns)).collect())))
    finally:
        spark.conf.unset("lifecurve.chunkRows")
    con = duckdb.connect()
    for table in ("events", "customer", "orders"):
        con.execute(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet')")
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    theirs = sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall())
    assert mine == theirs
