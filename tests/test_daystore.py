"""The store by day: files left alone, one pointer, replayed epochs, quarantine."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from helpers import demand, rows, ts
from staylens.operators.merge import merge_incremental
from staylens.plans import daystore, publish
from staylens.plans.increment import read_output, read_store
from staylens.streaming.increments import merge_epoch, start_increment_stream
from test_sources_stream import HEADER, write_csv

DAYS = [dt.date(2026, 8, d) for d in range(17, 21)]


def history(spark):
    out = [{"snapshot_at": ts(f"{h}:00:00", day), "ProductID": p, "view_volume": float(h)} for day in DAYS for h in (9, 10) for p in (1, 2)]
    out += [{"snapshot_at": None, "ProductID": 7}, {"snapshot_at": ts("9:00:00", DAYS[1]), "ProductID": None}]
    return demand(spark, out)


def files(folder):
    found = {}
    for base, _, names in os.walk(os.path.join(folder, "days")):
        for n in names:
            if n.endswith(".parquet"):
                path = os.path.join(base, n)
                found[os.path.relpath(path, folder)] = (os.stat(path).st_mtime_ns, os.path.getsize(path))
    return found


def same(df, want):
    columns = [c for c in want.columns if c not in ("load_seq", "row_seq")]
    return rows(df, *columns) == rows(want, *columns)


def test_only_changed_days_are_written(spark, tmpdir_path):
    daystore.create(spark, tmpdir_path, history(spark))
    store, before = daystore.DayStore(spark, tmpdir_path), files(tmpdir_path)
    assert same(store.read(store.manifest()), history(spark))
    upload = demand(spark, [
        {"snapshot_at": ts("10:00:00", DAYS[1]), "ProductID": 1, "view_volume": 99.0},  # a correction
        {"snapshot_at": ts("11:00:00", DAYS[1]), "ProductID": 3, "view_volume": 5.0},
        {"snapshot_at": ts("9:00:00", DAYS[2]), "ProductID": 2, "view_volume": 9.0},  # as stored
        {"snapshot_at": ts("9:00:00", dt.date(2026, 8, 30)), "ProductID": 1},
        {"snapshot_at": ts("9:00:00", DAYS[3]), "ProductID": None},
    ])
    whole = merge_incremental(history(spark), upload)
    staged = store.stage(upload)
    assert staged.stats == whole.stats.first().asDict()
    assert same(store.read(store.manifest()), history(spark))  # staged, not committed
    store.commit(staged.manifest)
    assert same(store.read(store.manifest()), whole.merged)
    assert same(store.read(store.manifest(), "previous"), history(spark))  # a pointer
    after = files(tmpdir_path)
    assert {k: after[k] for k in before} == before  # no file touched
    new = {k.split("/")[2] for k in after.keys() - before.keys()}
    assert new == {f"day={DAYS[1]}", "day=2026-08-30"}
    assert {k.split("/")[1] for k in after.keys() - before.keys()} == {"v=2"}


def test_an_upload_that_changes_nothing(spark, tmpdir_path):
    daystore.create(spark, tmpdir_path, history(spark))
    store, before = daystore.DayStore(spark, tmpdir_path), files(tmpdir_path)
    staged = store.stage(history(spark).where("snapshot_at IS NOT NULL"))
    assert staged.manifest is None and not staged.stats["data_changed"] and staged.stats["new_events"] == 0
    assert files(tmpdir_path) == before and store.manifest().number == 1


def test_a_lost_attempt_is_replaced_and_a_second_writer_refused(spark, tmpdir_path):
    daystore.create(spark, tmpdir_path, history(spark))
    store = daystore.DayStore(spark, tmpdir_path)
    first = demand(spark, [{"snapshot_at": ts("12:00:00", d), "ProductID": 5} for d in DAYS])
    store.stage(first)  # and crash
    second = demand(spark, [{"snapshot_at": ts("13:00:00", DAYS[0]), "ProductID": 6}])
    staged = store.stage(second)
    store.commit(staged.manifest)
    want = merge_incremental(history(spark), second).merged
    assert same(store.read(store.manifest()), want)  # days of the lost attempt are not named
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(staged.manifest)


def test_strict_errors_and_empty_store(spark, tmpdir_path):
    store = daystore.DayStore(spark, tmpdir_path)
    assert store.manifest() is None and store.quarantine() is None and read_store(spark, tmpdir_path) == (None, None)
    with pytest.raises(ValueError, match="no row of the upload"):
        store.stage(demand(spark, [{"ProductID": None}]))
    with pytest.raises(ValueError, match="such as 'cancelled'"):
        store.stage(demand(spark, [{"snapshot_at": ts("9:00:00"), "check_status": " Cancelled"}]))
    with pytest.raises(ValueError, match="unreadable"):
        store.stage(demand(spark, [{"snapshot_at": ts("9:00:00"), "checkin_date": None}]))
    with pytest.raises(FileNotFoundError, match="no published outputs"):
        read_output(spark, tmpdir_path, "engine")


def test_vacuum_keeps_what_manifests_name(spark, tmpdir_path):
    daystore.create(spark, tmpdir_path, history(spark))
    store = daystore.DayStore(spark, tmpdir_path)
    for h in (12, 13, 14):
        store.commit(store.stage(demand(spark, [{"snapshot_at": ts(f"{h}:00:00", DAYS[0]), "ProductID": 5}])).manifest)
    latest, previous = rows(store.read(store.manifest())), rows(store.read(store.manifest(), "previous"))
    assert store.vacuum(1) == [f"v=1/day={DAYS[0]}", f"v=2/day={DAYS[0]}"]
    assert rows(store.read(store.manifest())) == latest and rows(store.read(store.manifest(), "previous")) == previous


def test_markers_follow_the_manifest(spark, tmpdir_path):
    """A crash between the commit and the marker of the outputs is mended by the next merge."""
    from dataclasses import replace

    from staylens.plans.increment import merge_publish

    daystore.create(spark, tmpdir_path, history(spark))
    store = daystore.DayStore(spark, tmpdir_path)
    out = publish.publish_outputs(spark, {"summary": spark.range(1)}, os.path.join(tmpdir_path, "out"), mark=False)
    store.commit(replace(store.manifest(), number=2, outputs=out))
    assert publish.current_version(spark, os.path.join(tmpdir_path, "out")) is None
    assert read_output(spark, tmpdir_path, "summary").count() == 1
    done = merge_publish(spark, tmpdir_path, history(spark).where("snapshot_at IS NOT NULL"), None, os.path.join(tmpdir_path, "out"))
    assert done["published"] is None and publish.current_version(spark, os.path.join(tmpdir_path, "out")) == "v=1"


BASE = ["2026-08-20", "1", "H", "Bangkok", "0.5", "0.8", "continues", "100"]


def test_stream_sets_bad_rows_aside_and_goes_on(spark, tmpdir_path):
    landing, store_dir = os.path.join(tmpdir_path, "landing"), os.path.join(tmpdir_path, "store")
    os.makedirs(landing)
    bad = ["2026-08-20", "2", "H", "Bangkok", "0.5", "0.8", "sold out", "100"]
    write_csv(os.path.join(landing, "day1.csv"), HEADER, [["2026-08-19 10:00:00", *BASE, "5"], ["2026-08-19 10:00:00", *bad, "5"], ["yesterday", *BASE, "5"]])
    checkpoint = os.path.join(tmpdir_path, "ckpt")
    start_increment_stream(spark, landing, store_dir, checkpoint).awaitTermination(120)
    write_csv(os.path.join(landing, "day2.csv"), HEADER, [["2026-08-18 10:00:00", *BASE, "6"]])  # late
    start_increment_stream(spark, landing, store_dir, checkpoint).awaitTermination(120)
    latest, previous = read_store(spark, store_dir)
    assert rows(latest, "view_volume") == [(5.0,), (6.0,)] and rows(previous, "view_volume") == [(5.0,)]
    store = daystore.DayStore(spark, store_dir)
    assert rows(store.quarantine(), "reason", "ProductID") == [("invalid key", 1), ("unsupported status", 2)]


def test_replayed_epoch_changes_nothing(spark, tmpdir_path):
    columns = ", ".join(f"`{c}` string" for c in HEADER)
    one = spark.createDataFrame([("2026-08-19 10:00:00", *BASE, "5"), ("never", *BASE, "5")], columns)
    other = spark.createDataFrame([("2026-08-19 10:00:00", *BASE, "8")], columns)
    run = merge_epoch(tmpdir_path, "a")
    run(one, 0)
    store = daystore.DayStore(spark, tmpdir_path)
    state, before = store.manifest(), files(tmpdir_path)
    run(one, 0)
    run(other, 0)  # the same epoch, whatever it brings
    assert store.manifest() == state and files(tmpdir_path) == before and store.quarantine().count() == 1
    run(other, 1)
    merge_epoch(tmpdir_path, "b")(one, 0)  # another stream has epochs of its own
    assert store.manifest().epochs == {"a": 1, "b": 0}
    assert rows(store.read(store.manifest()), "view_volume") == [(5.0,)]
    assert store.quarantine().where(F.col("reason") == "invalid key").count() == 2
