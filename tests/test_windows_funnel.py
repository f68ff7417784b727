"""F4 windows (FX9) and F1-F3 coverage-normalised change (FX3)."""

import datetime as dt

from pyspark.sql import functions as F

from helpers import demand, rows, ts
from staylens.operators import funnel as FN, periods as P, summary as S
from staylens.operators.ranking import global_row_number
from staylens.sources import feeds


def _batches(spark, starts, **extra):
    return demand(spark, [{"snapshot_at": ts(s), **extra} for s in starts])


def test_fx9_new_rows(spark):
    prev_stamps = ["10:00:00", "11:00:00", "12:00:00", "13:00:00"]
    prev = _batches(spark, prev_stamps)
    latest = _batches(spark, prev_stamps + ["14:00:00", "15:00:00"])
    w = P.select_periods(latest, prev, 300)
    assert w.current_batches == 2
    assert rows(w.current, "snapshot_at") == [(ts("14:00:00"),), (ts("15:00:00"),)]
    assert rows(w.baseline, "snapshot_at") == [(ts("12:00:00"),), (ts("13:00:00"),)]


def test_reused_tables_are_written_not_cached(spark):
    prev = _batches(spark, ["10:00:00", "11:00:00"], ProductID=1)
    latest = _batches(spark, ["10:00:00", "11:00:00", "14:00:00"], ProductID=1)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    w = P.select_periods(latest, prev, 300)
    summary = S.demand_summary(w.current)
    ranked = global_row_number(summary, [F.col("ProductID").asc()], "rank")
    assert rows(ranked, "ProductID", "rank") == [(1, 1)]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert "InMemoryTableScan" not in ranked._jdf.queryExecution().toString()


def test_fx9_no_new_rows_uses_latest_day(spark):
    day2 = dt.date(2026, 8, 20)
    stamps = [ts("10:00:00"), ts("11:00:00"), ts("12:00:00"), ts("09:00:00", day2)]
    latest = demand(spark, [{"snapshot_at": s} for s in stamps])
    w = P.select_periods(latest, latest, 300)
    assert rows(w.current, "snapshot_at") == [(ts("09:00:00", day2),)]
    assert rows(w.baseline, "snapshot_at") == [(ts("12:00:00"),)]


def test_fx9_no_earlier_rows_means_no_baseline(spark):
    latest = _batches(spark, ["10:00:00", "11:00:00"])
    w = P.select_periods(latest, None, 300)
    assert w.baseline is None


def test_fx9_backfilled_stamp(spark):
    prev = _batches(spark, ["10:00:00", "11:00:00", "12:00:00", "13:00:00"])
    latest = _batches(spark, ["10:00:00", "11:00:00", "11:30:00", "12:00:00", "13:00:00"])
    w = P.select_periods(latest, prev, 300)
    assert [r[0] for r in rows(w.current, "snapshot_at")] == [ts("11:30:00"), ts("12:00:00"), ts("13:00:00")]


def _empty_feeds(spark):
    b = spark.createDataFrame([], "ProductID bigint, CheckInDate date, booking_count double")
    i = spark.createDataFrame([], "ProductID bigint, stayDate date, `Market Margin Gap` string")
    o = spark.createDataFrame([], "`Hotel Id` bigint, `2026-08-19` double")
    return feeds.bookings(b), feeds.internal_parity(i), feeds.ota_parity(o)


def test_fx3_change_status(spark):
    cur, base = [], []
    cases = [(30, 30, "continues", "Down"), (30, 10, "continues", "Up"), (30, 20, "continues", "No change"),
             (30, None, "continues", "New"), (30, 30, "new entry", "New")]
    for pid, (v, pv, status, _) in enumerate(cases, start=1):
        for k, t in enumerate(["10:00:00", "11:00:00", "12:00:00"]):
            cur.append({"snapshot_at": ts(t), "ProductID": pid, "view_volume": v / 3, "check_status": status})
        if pv is not None:
            for t in ["08:00:00", "09:00:00"]:
                base.append({"snapshot_at": ts(t), "ProductID": pid, "view_volume": pv / 2})
    from staylens.operators.batches import with_batches

    c = with_batches(demand(spark, cur), 300)
    b = with_batches(demand(spark, base), 300)
    f = FN.hotel_date_funnel(c, b, *_empty_feeds(spark))
    got = {r["ProductID"]: r for r in f.collect()}
    for pid, (_, _, _, want) in enumerate(cases, start=1):
        assert got[pid]["Upload_Change_Status"] == want
    assert round(got[1]["Comparable_Views"], 9) == 20.0 and round(got[1]["Previous_Comparable_Views"], 9) == 30.0
    f0 = FN.hotel_date_funnel(c, None, *_empty_feeds(spark))
    assert {r[0] for r in f0.select("Upload_Change_Status").collect()} == {"No baseline"}
    assert f0.where(F.col("Previous_Views").isNotNull()).count() == 0
