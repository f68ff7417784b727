"""Feeds (FX10, FX11), scores (FX5), bands (FX6), action order (FX15)."""

import datetime as dt

from pyspark.sql import functions as F

from helpers import rows
from staylens.operators import engine as E
from staylens.operators.summary import with_demand_score
from staylens.sources import feeds

DAY = dt.date(2026, 8, 19)


def test_fx10_internal_parity(spark):
    raw = spark.createDataFrame([(1, DAY, g) for g in ["-", "", "-3.5", "2"]],
                                "ProductID bigint, stayDate date, `Market Margin Gap` string")
    r = feeds.internal_parity(raw).first()
    assert (r.Internal_Worst_Gap, r.Internal_Median_Gap, r.Internal_Comparable_Rates, r.Internal_Total_Rates) == (
        -3.5, -0.75, 2, 4)


def test_fx11_ota_parity(spark):
    wide = spark.createDataFrame(
        [(1, "a", 0.0, -7.0, 2.0, None), (1, "b", 0.0, -1.0, 2.0, None)],
        "`Hotel Id` bigint, `Hotel Name` string, `2026-08-19` double, `2026-08-20` double, `2026-08-21` double,"
        " `2026-08-22` double",
    )
    got = rows(feeds.ota_parity(wide), "stay_date", "Agoda_Raw_Gap", "Agoda_Price_Disadvantage")
    assert got == [(DAY, 0.0, 0.0), (dt.date(2026, 8, 20), -7.0, 7.0), (dt.date(2026, 8, 21), 2.0, 0.0),
                   (dt.date(2026, 8, 22), None, None)]


def _engine(spark):
    summary = spark.createDataFrame(
        [(1, "H1", 0.8, 0.5, 50.0, 3), (2, "H2", 0.0, 0.0, 200.0, 6)],
        "ProductID bigint, ProductName string, Current_Hotness double, Current_Trend double, Current_Views double,"
        " Active_View_Intervals bigint",
    )
    summary = with_demand_score(summary)
    master = spark.createDataFrame([(1, "Hotel One", "Bangkok", "Resort", "Central", 1)],
                                   "ProductID bigint, ProductName string, Destination string, "
                                   "`HotelType Short` string, Region string, row_seq bigint")
    perf = spark.createDataFrame(
        [(1, "H1", "no room", "Not Live", 400000.0, 30.0, 1), (2, "H2", "Mapped", "Mapped", 1000000.0, 120.0, 2),
         (1, "H1", "no room", "Not Live", 10.0, 1.0, 3)],
        "ProductID bigint, ProductName string, `Agoda Status` string, `Ctrip Status` string, Revenue double,"
        " `B2B2C RN` double, row_seq bigint",
    )
    return E.build_engine(summary, master, perf)


def test_fx5_scores(spark):
    e = {r.ProductID: r for r in _engine(spark).collect()}
    h = e[1]
    assert h.Demand_Score == 57.0
    assert (h["Revenue Score"], h["RN Score"], h["Mapping Score"]) == (40.0, 25.0, 55.0)
    assert h["Business Score"] == 38.9
    assert h["Opportunity Index"] == 46.05
    assert h.Action == "Complete Room-Type Mapping"
    assert h.ProductName == "Hotel One"


def test_fx5_scores_v2(spark):
    v2 = {r.ProductID: r for r in E.scores_v2(_engine(spark)).collect()}
    assert v2[1]["Mapping Score v2"] == 0 and v2[1]["Opportunity Score v2"] == 38.9


def test_fx6_bands(spark):
    df = spark.createDataFrame([(r,) for r in [50, 51, 200, 201, 500, 501]], "r bigint")
    got = [x[0] for x in df.select(E.priority_band(F.col("r"))).collect()]
    assert got == ["Critical", "High", "High", "Medium", "Medium", "Low"]


def test_fx15_action_order(spark):
    df = spark.createDataFrame(
        [("Not Mapped", "Mapped", -1.0, None, 0.0, 0.0, 10.0, 10.0),
         ("Unknown", "Mapped", None, None, 5.0, 1.0, 10.0, 70.0),
         ("Unknown", "Mapped", None, None, 5.0, 1.0, 10.0, 69.99)],
        "`Agoda Status` string, `Ctrip Status` string, Internal_Worst_Gap double, Agoda_Price_Disadvantage double,"
        " Funnel_Views double, Funnel_Bookings double, Demand_Score double, `Opportunity Index` double",
    )
    got = [r[0] for r in df.select(E.recommend_action(df)).collect()]
    assert got == ["Map Hotel to Agoda", "Protect Commercial Performance", "Monitor"]


def test_max_scale_zero(spark):
    from staylens.operators.summary import max_scale

    df = spark.createDataFrame([(0.0,), (None,)], "v double")
    assert [r[0] for r in df.select(max_scale(df, "v")).collect()] == [0.0, 0.0]
