"""Registered queries against their DuckDB SQL at sf0.001, and the entry smoke check."""

import duckdb
import pytest

import __spark_entry__ as E
from staylens.catalog import QUERIES, SQL
from conftest import SMOKE

FAST = ["observation_batches", "hotel_checkin_gap900", "destination_checkin_gap900", "select_periods",
        "historical_hotel_date", "scan_internal_parity", "scan_ota_parity", "merge_stats", "snapshot_week",
        "hotel_trend"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "orders", "lineitem", "events"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return c


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple("NULL" if v is None else (repr(round(v, 9)) if isinstance(v, float) else str(v)) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    df = E.queries()[name](spark, SMOKE)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    got = _norm(tuple(r[c] for c in order) for r in df.collect())
    idx = [rel.columns.index(c) for c in order]
    want = _norm(tuple(r[i] for i in idx) for r in rel.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "Commercial Rank" in df.columns
