"""Levels (FX7), incomplete check-in week (FX12), ISO week label (FX14)."""

import datetime as dt

from pyspark.sql import functions as F

from helpers import rows
from staylens.operators import views as V, weeks as W

DETAIL_SCHEMA = ("ProductID bigint, checkin_date date, Destination string, Destination_Searches double, "
                 "view_volume double, ProductName string, Region string")


def test_fx7_levels(spark):
    days = [dt.date(2026, 8, d) for d in range(1, 6)]
    detail = spark.createDataFrame(
        [(1, d, "X", s, 1.0, "H", "R") for d, s in zip(days, [100.0, 200.0, 300.0, 400.0, 1000.0])], DETAIL_SCHEMA)
    got = rows(V.daily_market(detail), "checkin_date", "Demand Level")
    assert [g[1] for g in got] == ["Low", "Low", "Medium", "High", "Very High"]


def test_fx12_incomplete_week(spark):
    monday = dt.date(2026, 8, 17)
    cur = [(1, monday + dt.timedelta(days=i), "X", 100.0, 1.0, "H", "R") for i in range(5)]
    prev = [(1, monday - dt.timedelta(days=7 - i), "X", 80.0, 1.0, "H", "R") for i in range(7)]
    detail = spark.createDataFrame(cur + prev, DETAIL_SCHEMA)
    k = W.checkin_week_kpis(detail).where(F.col("week_start") == F.lit(monday)).first()
    assert (k.Current_Total, k.Previous_Total, k.Current_Days, k.Previous_Days) == (500.0, 560.0, 5, 7)
    assert (k.Current_Basis, k.Previous_Basis, k.Change) == (100.0, 80.0, 20.0)
    assert k.Change_Pct == 0.25 and k.Signal == "Critical surge" and not k.Complete


def test_fx14_iso_week(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 1, 12, 0),)], "snapshot_at timestamp_ntz")
    r = W.week_options(df).first()
    assert r.week_start == dt.date(2024, 12, 30)
    assert r.label == "2025-W01 (30 Dec–05 Jan)"


def test_f12_checkin_weeks(spark):
    days = [dt.date(2024, 12, 30), dt.date(2025, 1, 5), dt.date(2025, 1, 6), None]
    detail = spark.createDataFrame([(d,) for d in days], "checkin_date date")
    assert rows(W.checkin_week_options(detail)) == [
        (dt.date(2024, 12, 30), "2025-W01 (30 Dec–05 Jan)"), (dt.date(2025, 1, 6), "2025-W02 (06 Jan–12 Jan)")]


def test_f16_newest_snapshot_and_high_dates(spark):
    days = [dt.date(2026, 8, d) for d in range(1, 6)]
    detail = spark.createDataFrame(
        [(1, d, "X", s, 1.0, "H", "R") for d, s in zip(days, [100.0, 200.0, 300.0, 400.0, 1000.0])], DETAIL_SCHEMA)
    crawls = [dt.datetime(2026, 8, 3, 9), None, dt.datetime(2026, 7, 1, 9)]
    demand = spark.createDataFrame([(s,) for s in crawls], "snapshot_at timestamp_ntz")
    daily = V.daily_market(detail)
    assert rows(W.freshness(demand, daily)) == [(crawls[0], 2)]
    assert rows(W.freshness(demand.limit(0), daily.limit(0))) == [(None, 0)]


def test_week_signal_new_demand(spark):
    monday = dt.date(2026, 8, 17)
    detail = spark.createDataFrame(
        [(1, monday, "X", 50.0, 3.0, "H", "R"), (1, monday - dt.timedelta(days=3), "Y", 10.0, 1.0, "H", "R")],
        DETAIL_SCHEMA)
    h = W.checkin_week_hotels(detail).where(F.col("week_start") == F.lit(monday)).first()
    assert h["Destination Signal"] == "New demand" and h.Priority == 1
