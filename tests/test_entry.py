from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"


def test_smoke_query_matches_sql(spark):
    con = duckdb.connect()
    for name in ("lineitem", "orders", "customer", "nation", "region"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = sorted(con.sql(e.oracle_sql()["revenue_by_region_year"]).fetchall())
    got = sorted(tuple(r) for r in e.queries()["revenue_by_region_year"](spark, SF).collect())
    assert len(got) == 35
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=0.01)


def test_entry_has_rows_and_columns(spark):
    df = e.entry(spark)
    assert df.columns == ["r_name", "order_year", "line_count", "revenue"]
    assert df.count() == 35


def test_every_sql_belongs_to_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
