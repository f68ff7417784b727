"""CSV landing, discovery, versioned publish and the availableNow stream."""

import os
import time

from helpers import rows
from staylens.operators import clean
from staylens.plans import publish
from staylens.plans.daystore import DayStore
from staylens.plans.increment import read_store
from staylens.sources import files
from staylens.streaming.increments import start_increment_stream

HEADER = ["Time Stamp", "CheckInDate", "ProductID", "ProductName", "Destination", "trend_momentum",
          "hotness_score", "check_status", "search_volume", "view_volume"]


def write_csv(path, header, lines):
    with open(path, "w") as fh:
        fh.write(",".join(header) + "\n")
        for line in lines:
            fh.write(",".join(line) + "\n")


def test_csv_binds_columns_by_name(spark, tmpdir_path):
    raw = os.path.join(tmpdir_path, "raw")
    os.makedirs(raw)
    reordered = list(reversed(HEADER))
    line = dict(zip(HEADER, ["2026-08-19 10:00:00", "2026-08-20", "12.0", "H", "Bangkok", "0.5", "0.8",
                              " Modify ", "100", "NA"]))
    write_csv(os.path.join(raw, "demand_latest.csv"), reordered, [[line[c] for c in reordered]])
    df = clean.prepare_demand(files.scan_demand(spark, raw)).first()
    assert df.ProductID == 12 and df.view_volume is None and df.check_status == "modify"
    assert df.search_volume == 100.0 and str(df.checkin_date) == "2026-08-20"
    assert files.scan_previous(spark, raw) is None


def test_discover_newest_valid_csv(spark, tmpdir_path):
    raw = os.path.join(tmpdir_path, "raw")
    os.makedirs(raw)
    write_csv(os.path.join(raw, "old.csv"), HEADER, [])
    time.sleep(1.1)
    write_csv(os.path.join(raw, "new.csv"), HEADER, [])
    write_csv(os.path.join(raw, "other.csv"), ["a", "b"], [])
    assert files.discover_source(spark, raw).endswith("new.csv")


def test_dimension_sheets_round_trip(spark, tmpdir_path):
    import pytest

    sheet = [["7", "Hotel, one", "North"], ["8", "Hôtel", ""], ["9", "H", "East"]]
    quoted = [[x if "," not in x else f'"{x}"' for x in line] for line in sheet]
    write_csv(os.path.join(tmpdir_path, "master.csv"), ["ProductID", "ProductName", "Region"], quoted)
    want = [tuple(x or None for x in line) for line in sheet]
    columns = ["ProductID", "ProductName", "Region"]
    landed = files.scan_table(spark, os.path.join(tmpdir_path, "master.csv"), load_seq=3)
    assert [tuple(r) for r in landed.orderBy("row_seq").select(*columns).collect()] == want
    assert {r.load_seq for r in landed.collect()} == {3}
    for name in ("one.parquet", "folder"):
        landed.select(*columns).coalesce(1).write.parquet(out := os.path.join(tmpdir_path, name))
        again = files.scan_table(spark, out)
        assert [tuple(r) for r in again.orderBy("row_seq").select(*columns).collect()] == want
    with pytest.raises(ValueError, match="Excel"):
        files.scan_table(spark, os.path.join(tmpdir_path, "master.xlsx"))


def test_coordinates_round_trip(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "coordinates.csv")
    write_csv(path, ["Longitude", "Destination", "Latitude"], [["100.5", "Bangkok", "13.75"], ["x", "Nowhere", ""]])
    got = files.scan_coordinates(spark, path)
    assert got.columns == ["Destination", "Latitude", "Longitude"]
    assert rows(got) == [("Bangkok", 13.75, 100.5), ("Nowhere", None, None)]


def test_missing_columns_are_named(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "bad.csv")
    write_csv(path, HEADER[:-2], [])
    import pytest

    with pytest.raises(ValueError, match="search_volume, view_volume"):
        files.scan_demand(spark, tmpdir_path, path=path)


def test_publish_versions_and_snapshots(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "out")
    t = spark.createDataFrame([(1, 5, "Monitor")], "ProductID bigint, `Commercial Rank` bigint, Action string")
    publish.publish_outputs(spark, {"engine": t}, out)
    unmarked = publish.publish_outputs(spark, {"engine": t.limit(0)}, out, mark=False)
    assert unmarked.endswith("v=2")
    assert files.read_published(spark, out, "engine").count() == 1  # v=2 was never marked
    assert files.read_published(spark, out, "top20").count() == 1
    snaps = os.path.join(tmpdir_path, "snaps")
    import datetime as dt

    publish.save_snapshot(t, snaps, dt.date(2026, 8, 18))
    assert files.latest_two_snapshots(spark, snaps) == (None, None)
    publish.save_snapshot(t, snaps, dt.date(2026, 8, 19))
    publish.save_snapshot(t, snaps, dt.date(2026, 8, 19))  # same day again: partition replaced
    y, d = files.latest_two_snapshots(spark, snaps)
    assert y.count() == 1 and d.count() == 1


def test_stream_merges_each_export(spark, tmpdir_path):
    landing = os.path.join(tmpdir_path, "landing")
    os.makedirs(landing)
    store = os.path.join(tmpdir_path, "store")
    base = ["2026-08-20", "1", "H", "Bangkok", "0.5", "0.8", "continues", "100"]
    write_csv(os.path.join(landing, "day1.csv"), HEADER,
              [["2026-08-19 10:00:00", *base, "5"], ["2026-08-19 11:00:00", *base, "6"]])
    q = start_increment_stream(spark, landing, store, os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(120)
    latest, _ = read_store(spark, store)
    assert latest.count() == 2
    write_csv(os.path.join(landing, "day2.csv"), HEADER,
              [["2026-08-19 11:00:00", *base, "9"], ["2026-08-19 12:00:00", *base, "1"]])
    q = start_increment_stream(spark, landing, store, os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(120)
    latest, previous = read_store(spark, store)
    assert rows(latest, "view_volume") == [(1.0,), (5.0,), (9.0,)]
    assert previous.count() == 2


def test_merge_publish_versions(spark, tmpdir_path):
    from pyspark.sql import functions as F

    from conftest import SMOKE
    from staylens.plans.increment import merge_publish
    from staylens.plans.rebuild import driver_sources
    from staylens.sources import driver_tables as T

    dims = driver_sources(spark, SMOKE)
    store, out = os.path.join(tmpdir_path, "store"), os.path.join(tmpdir_path, "out")
    first = merge_publish(spark, store, T.demand_previous(spark, SMOKE), dims, out, 300)
    assert first["published"].endswith("v=1") and first["new_events"] > 0
    upload = T.demand_latest(spark, SMOKE).where(
        (F.col("snapshot_at") >= F.lit(T.PREVIOUS_CUTOFF).cast("timestamp_ntz")) | (F.col("load_seq") == 1)
    )
    second = merge_publish(spark, store, upload, dims, out, 300)
    assert second["published"].endswith("v=2") and second["data_changed"]
    again = merge_publish(spark, store, upload, dims, out, 300)
    assert again["published"] is None and not again["data_changed"]
    assert files.read_published(spark, out, "engine").count() > 0
    assert DayStore(spark, store).manifest().number == 2
