"""A2 / A3 / A4 on hand-written fixtures (FX2)."""

import datetime as dt

from helpers import D, demand, rows, ts
from staylens.operators import facts


def fx2(spark):
    return demand(spark, [
        {"snapshot_at": ts("10:00:00"), "ProductID": 1, "search_volume": 100.0, "view_volume": 5.0},
        {"snapshot_at": ts("10:02:00"), "ProductID": 1, "search_volume": 120.0, "view_volume": 7.0},
        {"snapshot_at": ts("10:02:00"), "ProductID": 2, "search_volume": 200.0, "view_volume": None},
        {"snapshot_at": ts("11:00:00"), "ProductID": 1, "search_volume": 90.0, "view_volume": 4.0},
    ])


def test_fx2_hotels(spark):
    h = facts.hotel_checkin(fx2(spark), 300)
    assert rows(h, "ProductID", "view_volume", "Interval_Count", "search_volume") == [
        (1, 11.0, 2, 105.0), (2, 0.0, 1, 200.0)]


def test_fx2_destination(spark):
    d = facts.destination_checkin(fx2(spark), 300)
    assert rows(d, "Destination", "Destination_Searches", "Destination_Intervals", "Destination_Search_Snapshot") == [
        ("Bangkok", 210.0, 2, ts("11:00:00"))]


def test_keep_last_uses_load_order(spark):
    df = demand(spark, [
        {"snapshot_at": ts("10:00:00"), "view_volume": 5.0, "load_seq": 0},
        {"snapshot_at": ts("10:00:00"), "view_volume": 6.0, "load_seq": 1, "Destination": None},
    ])
    h = facts.hotel_checkin(df, 300)
    assert rows(h, "view_volume", "Destination") == [(6.0, None)]


def test_history_prefers_latest_load(spark):
    prev = demand(spark, [{"snapshot_at": ts("10:00:00"), "view_volume": 5.0}])
    latest = demand(spark, [{"snapshot_at": ts("10:00:00"), "view_volume": 9.0},
                            {"snapshot_at": ts("12:00:00"), "view_volume": 1.0}])
    hotels, dest = facts.stored_history(latest, prev, 300)
    assert rows(hotels, "Total_Observed_Views", "Historical_View_Intervals") == [(10.0, 2)]
    assert rows(dest, "Historical_Search_Intervals") == [(2,)]


def test_facts_keep_the_last_row_without_sorting_to_aggregate(spark):
    df = demand(spark, [{"snapshot_at": ts("10:00:00"), "ProductID": p} for p in (1, 2)])
    plans = [facts.hotel_checkin(df, 300), *facts.stored_history(df, df, 300), facts.checkin_date_trend(df, 300), facts.full_history_funnel(df, 300), facts.hotel_trend(df, 300)]
    for plan in plans:
        assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()


def test_packed_order_is_the_order_of_its_columns(spark):
    import itertools

    import pytest

    stamps = [None, ts("10:00:00"), ts("10:00:00", dt.date(1969, 1, 2)), ts("23:59:59", dt.date(2285, 12, 31))]
    cases = [(s, load, row) for s, load, row in itertools.product(stamps, [None, 0, 1, 99_998], [None, 0, 7, 10**17 - 2])]
    df = demand(spark, [{"snapshot_at": s, "load_seq": load, "row_seq": row, "ProductName": str(i)} for i, (s, load, row) in enumerate(cases)])
    got = [int(r.ProductName) for r in df.withColumn("o", facts.packed_order(facts.ORDER)).orderBy("o").collect()]
    key = lambda c: tuple((x is not None, x if x is not None else 0) for x in c)
    assert [cases[i] for i in got] == sorted(cases, key=lambda c: (c[0] is not None, c[0] or ts("0:00:00"), key(c[1:])))
    with pytest.raises(Exception, match="(?i)out of range|overflow|cannot be represented"):
        demand(spark, [{"row_seq": 10**17}]).select(facts.packed_order(["row_seq"])).collect()


def test_latest_per_key_with_null_keys_matches_plain_python(spark):
    import random

    r = random.Random(2)
    data = [{"ProductID": r.choice([None, 1, 2]), "checkin_date": r.choice([None, D]), "snapshot_at": r.choice([None, ts("10:00:00"), ts("11:00:00")]),
             "load_seq": r.choice([0, 1]), "row_seq": i} for i in range(60)]
    best = {}
    for d in data:
        k, o = (d["ProductID"], d["checkin_date"]), (d["snapshot_at"] is not None, d["snapshot_at"] or ts("0:00:00"), d["load_seq"], d["row_seq"])
        best[k] = max(best.get(k, o), o)
    got = facts.latest_per_key(demand(spark, data), ["ProductID", "checkin_date"]).collect()
    assert {(x.ProductID, x.checkin_date): x.row_seq for x in got} == {k: o[3] for k, o in best.items()} and len(got) == len(best)
