"""The driver contract: every query runs, and agrees with its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    return f"{v:.5g}" if isinstance(v, float) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.catalogue.queries()))
def test_query(spark, name):
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "rank", "score"]
