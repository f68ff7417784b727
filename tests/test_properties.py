
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SMOKE
from staylens.operators import batches, clean
from staylens.operators.joins import repeated_keys
from staylens.operators.merge import merge_incremental
from staylens.plans.rebuild import Rebuild, driver_sources
from staylens.sources import driver_tables as T


def test_funnel_and_engine_keys_unique(spark):
    r = Rebuild(driver_sources(spark, SMOKE), 300)
    assert repeated_keys(r.funnel, ["ProductID", "checkin_date"]).count() == 0
    assert repeated_keys(r.engine, ["ProductID"]).count() == 0
    ranks = [x[0] for x in r.engine.select("`Commercial Rank`").collect()]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))


def test_batch_rows_add_up(spark):
    lat = clean.prepare_demand(T.demand_latest(spark, SMOKE))
    b = batches.with_batches(lat, 60)
    assert b.count() == lat.where(F.col("snapshot_at").isNotNull()).count()


def test_merge_independent_of_order_and_partitions(spark):
    hist = T.demand_previous(spark, SMOKE)
    up = T.demand_latest(spark, SMOKE).where(F.col("load_seq") == 1)
    a = merge_incremental(hist, up).merged
    b = merge_incremental(hist.repartition(7).orderBy(F.rand(1)), up.repartition(3).orderBy(F.rand(2))).merged
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    again = merge_incremental(a, up.withColumn("load_seq", F.lit(2))).stats.first()
    assert not again.data_changed and again.new_events == 0


def test_no_python_udf_in_registered_plans(spark):
    for name in ["hotel_checkin", "destination_checkin", "snapshot_week", "hotel_trend", "merge_stats"]:
        plan = E.queries()[name](spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
        assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan, name


def test_time_filters_reach_the_scan(spark):
    lat = clean.prepare_demand(T.demand_latest(spark, SMOKE))
    plan = lat.where(F.col("snapshot_at") >= F.lit("2024-01-20").cast("timestamp_ntz"))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_top_k_per_date_is_limited_before_the_shuffle(spark):
    plan = E.queries()["date_worklist"](spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_week_priorities_are_a_ranking_per_week(spark):
    df = E.queries()["checkin_week_hotels"](spark, SMOKE)
    per_week = df.groupBy("week_start").agg(F.count(F.lit(1)).alias("n"), F.min("Priority").alias("lo"),
                                            F.max("Priority").alias("hi"), F.count_distinct("Priority").alias("d"))
    for r in per_week.collect():
        assert (r.lo, r.hi, r.d) == (1, r.n, r.n)
