"""A1 batching: FX1, and both physical paths give the single-window ids."""

import datetime as dt
import random

import pytest

import datetime as dt

from pyspark.sql import Window, functions as F

from helpers import demand, rows, ts
from staylens.operators import batches


def test_fx1(spark):
    df = demand(spark, [{"snapshot_at": ts(t)} for t in ["10:00:00", "10:05:00", "10:10:01", "10:10:01"]])
    got = rows(batches.batch_map(df, 300), "snapshot_at", "Observation_Batch", "Observation_At")
    assert got == [
        (ts("10:00:00"), 1, ts("10:05:00")),
        (ts("10:05:00"), 1, ts("10:05:00")),
        (ts("10:10:01"), 2, ts("10:10:01")),
    ]


def _stamps(spark):
    base = dt.datetime(2026, 8, 18, 23, 50, 0)
    offs = [0, 300, 601, 602, 900, 1199, 1500, 1501, 2101, 86400, 86400 + 299, 86400 + 600]
    micro = [dt.timedelta(microseconds=m) for m in (0, 1, 999999)]
    stamps = [base + dt.timedelta(seconds=o) + m for o in offs for m in micro]
    return demand(spark, [{"snapshot_at": s} for s in stamps] + [{"snapshot_at": None}])


def _single_window(df, gap):
    """The same batches from one ordered window over all stamps."""
    w = Window.orderBy("snapshot_at")
    start = F.coalesce((F.col("snapshot_at") - F.lag("snapshot_at").over(w) > F.expr(f"INTERVAL '{gap}' SECOND")).cast("int"), F.lit(1))
    d = df.where("snapshot_at IS NOT NULL").select("snapshot_at").distinct().withColumn("s", start)
    d = d.withColumn("Observation_Batch", F.sum("s").over(w).cast("bigint"))
    return d.select("snapshot_at", "Observation_Batch", F.max("snapshot_at").over(Window.partitionBy("Observation_Batch")).alias("Observation_At"))


def test_bucketed_equals_single_window(spark):
    df = _stamps(spark)
    cols = ("snapshot_at", "Observation_Batch", "Observation_At")
    for gap in (1, 299, 300, 900, 3600):
        assert rows(_single_window(df, gap), *cols) == rows(batches.batch_map(df, gap), *cols), gap


def test_bucketed_equals_single_window_on_events(spark):
    from staylens.sources import driver_tables as T
    from conftest import SMOKE

    df = T.demand_latest(spark, SMOKE)
    a, b = _single_window(df, 60), batches.batch_map(df, 60)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_scoped_batches_restart(spark):
    df = demand(spark, [{"snapshot_at": ts(t), "ProductID": p} for t in ["10:00:00", "11:00:00"] for p in (1, 2)])
    m = batches.batch_map(df.withColumn("scope", F.col("ProductID")), 300, scope=["scope"])
    assert rows(m, "scope", "Observation_Batch") == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_bucketed_plan_has_no_single_partition_exchange(spark):
    df = _stamps(spark)
    plan = batches.batch_map(df, 300)._jdf.queryExecution().executedPlan().toString()
    # the stamp-level window is partitioned by minute; only the one-row-per-minute level is global
    assert "hashpartitioning(_minute" in plan
    assert "InMemoryTableScan" not in plan  # no level is cached
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize("gap", [0, 1, 20, 59, 60, 61, 300, 4000])
def test_ends_and_ids_match_one_ordered_scan(spark, gap):
    """Runs that end inside a minute, go through whole minutes, or cross several of them."""
    r = random.Random(gap)
    at, stamps = dt.datetime(2026, 8, 18, 23, 50), set()
    for _ in range(300):
        at += dt.timedelta(microseconds=r.choice([1, 500_000, 1_000_000, 20_000_000, 59_999_999, 60_000_000, 61_000_000, 300_000_000, 4_000_000_001]))
        stamps.add(at)
    want, number, run = {}, 0, []
    for s in sorted(stamps):
        if run and (s - run[-1]) > dt.timedelta(seconds=gap):
            number += 1
            want |= {x: (number, run[-1]) for x in run}
            run = []
        run.append(s)
    want |= {x: (number + 1, run[-1]) for x in run}
    df = demand(spark, [{"snapshot_at": s} for s in stamps])
    got = {x.snapshot_at: (x.Observation_Batch, x.Observation_At) for x in batches.batch_map(df, gap).collect()}
    assert got == want
