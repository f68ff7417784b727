"""Merge (FX4) and reconciliation (FX13)."""

import pytest
from pyspark.sql import functions as F

from helpers import demand, rows, ts
from staylens.operators import audit as AU
from staylens.operators.merge import merge_incremental


def _hist(spark):
    return demand(spark, [{"snapshot_at": ts("10:00:00"), "ProductID": 1, "view_volume": 5.0},
                          {"snapshot_at": None, "ProductID": 7, "view_volume": 1.0}])


def _upload(spark, load=1):
    return demand(spark, [{"snapshot_at": ts("10:00:00"), "ProductID": 1, "view_volume": 6.0, "load_seq": load},
                          {"snapshot_at": ts("11:00:00"), "ProductID": 2, "view_volume": 2.0, "load_seq": load},
                          {"snapshot_at": ts("11:00:00"), "ProductID": None, "load_seq": load}])


def test_fx4_merge_and_replay(spark):
    r = merge_incremental(_hist(spark), _upload(spark))
    s = r.stats.first()
    assert (s.history_rows, s.uploaded_rows, s.skipped_missing_product, s.new_events, s.duplicates_removed,
            s.merged_rows, s.data_changed) == (2, 3, 1, 1, 1, 3, True)
    assert rows(r.merged, "ProductID", "view_volume") == [(1, 6.0), (2, 2.0), (7, 1.0)]
    again = merge_incremental(r.merged, _upload(spark, 2)).stats.first()
    assert (again.new_events, again.duplicates_removed, again.data_changed) == (0, 2, False)
    corr = demand(spark, [{"snapshot_at": ts("10:00:00"), "ProductID": 1, "view_volume": 9.0, "load_seq": 3}])
    changed = merge_incremental(r.merged, corr).stats.first()
    assert (changed.new_events, changed.data_changed) == (0, True)


def test_fx4_errors(spark):
    bad = demand(spark, [{"snapshot_at": ts("10:00:00"), "check_status": "cancelled"}])
    with pytest.raises(ValueError, match="cancelled"):
        merge_incremental(_hist(spark), bad)
    with pytest.raises(ValueError, match="no row of the upload has a ProductID"):
        merge_incremental(_hist(spark), demand(spark, [{"snapshot_at": ts("10:00:00"), "ProductID": None}]))
    with pytest.raises(ValueError, match="1 upload rows have an unreadable"):
        merge_incremental(_hist(spark), demand(spark, [{"snapshot_at": ts("10:00:00"), "checkin_date": None}]))
    q = merge_incremental(_hist(spark), bad, strict=False)
    assert q.quarantine.count() == 1


def test_fx13_reconcile(spark):
    e = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "k string, v double")
    a = spark.createDataFrame([("A", 1.0000001), ("C", 3.0)], "k string, v double")
    r = AU.reconcile("t", e, a, ["k"], ["v"]).first()
    assert (r.missing_in_actual, r.missing_in_expected, r.value_different, r.passed) == (1, 1, 0, False)


def test_key_quality(spark):
    df = demand(spark, [{"snapshot_at": ts("10:00:00")}, {"snapshot_at": ts("10:00:00")},
                        {"snapshot_at": None}, {"snapshot_at": None}, {"ProductID": None, "snapshot_at": ts("9:00:00")}])
    r = AU.raw_key_quality(df).first()
    assert (r.invalid_timestamp_rows, r.missing_product_rows, r.duplicate_event_keys) == (2, 1, 2)
