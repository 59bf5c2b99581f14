"""Every registered query runs, and agrees with its SQL where it has one (smallest tables)."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows_of

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF_DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["mode"] == "dense" and row["n"] > 0 and 0 <= row["recall_1"] <= row["recall_20"] <= 1


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, got) == rows_of(names, want)
