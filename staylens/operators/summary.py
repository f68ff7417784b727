"""A5 demand summary per hotel, S1 max-scaling and S2 demand score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from staylens.functions import columns as C
from staylens.operators import facts
from staylens.session import cut_lineage

SUMMARY_COLUMNS = [
    "ProductID", "Current_Hotness", "Peak_Hotness", "Avg_Hotness", "Current_Trend",
    "Current_Views", "Peak_CheckIn_Views", "Latest_Snapshot", "ProductName",
    "Active_View_Intervals", "Modification_Count", "Last_Modified_At",
    "Peak_CheckIn_Date", "Demand_Score",
]


def max_scale(df: DataFrame, column: str) -> Column:
    """NULL -> 0, clip at 0, divided by the global maximum x 100; max 0 -> 0.

    The maximum is a scalar subquery (partial + final aggregate), not an
    unpartitioned window.
    """
    v = F.greatest(F.coalesce(F.col(f"`{column}`").cast("double"), F.lit(0.0)), F.lit(0.0))
    top = df.agg(
        F.max(F.greatest(F.coalesce(F.col(f"`{column}`").cast("double"), F.lit(0.0)), F.lit(0.0)))
    ).scalar()
    return F.when(F.coalesce(top, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(v / top * 100)


def demand_summary(current: DataFrame) -> DataFrame:
    o = facts.hotel_intervals(current, drop_null_dates=False)
    c = (
        o.where(F.col("checkin_date").isNotNull())
        .groupBy("ProductID", "checkin_date")
        .agg(
            F.avg("hotness_score").alias("hotness_score"),
            F.avg("trend_momentum").alias("trend_momentum"),
            C.sum0("view_volume").alias("view_volume"),
            F.max("snapshot_at").alias("snapshot_at"),
        )
    )
    per_date = c.groupBy("ProductID").agg(
        F.avg("hotness_score").alias("Current_Hotness"),
        F.max("hotness_score").alias("Peak_Hotness"),
        F.avg("hotness_score").alias("Avg_Hotness"),
        F.avg("trend_momentum").alias("Current_Trend"),
        F.sum("view_volume").alias("Current_Views"),
        F.max("view_volume").alias("Peak_CheckIn_Views"),
        F.max("snapshot_at").alias("Latest_Snapshot"),
        F.max_by("checkin_date", F.struct("view_volume", "checkin_date")).alias("Peak_CheckIn_Date"),
    )
    modified = F.col("check_status") == "modify"
    per_interval = o.groupBy("ProductID").agg(
        F.max_by(
            "ProductName",
            F.struct("snapshot_at", F.col("checkin_date").isNull(), "checkin_date", "load_seq", "row_seq"),
        ).alias("ProductName"),
        F.count_if(C.flag(F.col("view_volume") > 0)).alias("Active_View_Intervals"),
        F.count_if(modified).alias("Modification_Count"),
        F.max(F.when(modified, F.col("snapshot_at"))).alias("Last_Modified_At"),
    )
    # one row per hotel; written once, as the two global maxima below read it too
    summary = cut_lineage(per_date.join(per_interval, on="ProductID", how="inner"), "summary_base")
    return with_demand_score(summary).select(*SUMMARY_COLUMNS)


def with_demand_score(summary: DataFrame) -> DataFrame:
    """rint2(hotness x 40 + trend x 20 + 0.2 x scaled views + 0.2 x scaled active intervals)."""
    score = (
        F.coalesce("Current_Hotness", F.lit(0.0)) * 40
        + F.coalesce("Current_Trend", F.lit(0.0)) * 20
        + max_scale(summary, "Current_Views") * 0.20
        + max_scale(summary, "Active_View_Intervals") * 0.20
    )
    return summary.withColumn("Demand_Score", C.rint2(score))
