"""Batches kept by day: after any merge the map equals one made from all rows."""

import datetime as dt
import random

import pytest

from helpers import demand, rows
from staylens.operators import batches
from staylens.plans import batch_index, daystore

START = dt.datetime(2026, 8, 17, 22)


def stamps(r, n, start, longest):
    at, out = start, []
    for _ in range(n):
        at += dt.timedelta(microseconds=r.choice([1, 400_000, 30_000_000, 59_000_000, 61_000_000, 300_000_000, 300_000_001, longest]))
        out.append({"snapshot_at": at, "ProductID": r.randrange(5)})
    return out


@pytest.mark.parametrize("gap", [300, 3_000_000])  # the second: one batch through all days
def test_map_after_merges_equals_the_full_one(spark, tmpdir_path, gap):
    r = random.Random(gap)
    longest = 9_000_000_000
    first = demand(spark, [*stamps(r, 120, START, longest), {"snapshot_at": None, "ProductID": 1}])
    daystore.create(spark, tmpdir_path, first)
    store = daystore.DayStore(spark, tmpdir_path)
    index = batch_index.BatchIndex(store, gap)
    with pytest.raises(FileNotFoundError, match="not numbered"):
        index.batch_map()
    later = START + dt.timedelta(days=3)
    uploads = [stamps(r, 40, later, longest), stamps(r, 10, START + dt.timedelta(days=1, hours=5), 10_000_000),  # back-filled
               stamps(r, 10, START - dt.timedelta(days=2), 10_000_000)]  # before everything
    index.update()
    for upload in [None, *uploads]:
        if upload is not None:
            before = store.manifest()
            store.commit(store.stage(demand(spark, upload)).manifest)
            now = store.manifest()
            assert index.pending(now) == [now.number]
            read = index.changed_rows(now, now.number).inputFiles()
            assert read and all(f"/v={now.number}/" in f for f in read)  # new days only
            kept = [d for d in before.latest if now.latest[d] == before.latest[d]]
            assert kept and not any(f"/day={d}/" in f for f in read for d in kept)
            index.update()
        want = batches.batch_map(store.read(store.manifest()), gap)
        assert rows(index.batch_map(), *want.columns) == rows(want)
        assert index.pending(store.manifest()) == []


def test_renumbering_starts_at_the_last_break(spark):
    """Minutes before the break are taken over as they are: they need not be given again."""
    r = random.Random(1)
    data = demand(spark, stamps(r, 300, START, 9_000_000_000))
    _, minutes = batches.minute_gaps(data.select("snapshot_at").distinct(), 300)
    whole = batch_index.number(minutes, 300)
    old = batch_index.number(minutes.where("_minute < timestamp_ntz'2026-08-19 00:00:00'"), 300)
    asked = []

    def since(day):
        asked.append(day)
        return minutes.where(f"date_format(_minute, 'yyyy-MM-dd') >= '{day}'")

    assert rows(batch_index.renumber(old, since, "2026-08-19", 300)) == rows(whole)
    assert asked == ["2026-08-18"]
