import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare, rows_of

QUICK = ("candles_1h", "candles_weekly", "ind_kdj", "feat_structure", "audit_dataset", "capital_rotation", "settlement_status", "latency_p95", "news_radar", "registry_status", "path_risk", "ml_rank_ic")


def test_registry_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = entry.queries()[name](spark, sf).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    note, _ = compare(rows_of(got), rows_of(want))
    assert note is None, note
