"""Hotel x check-in funnel with coverage-normalised change.

Join order follows the partitioning: the hotel facts come out of an
aggregation hash-partitioned by (ProductID, checkin_date); bookings,
internal parity, OTA parity and the baseline hotel facts are all keyed the
same way, so those four left joins reuse one partitioning.  The two joins
on (Destination, checkin_date) come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from staylens.functions import columns as C
from staylens.operators import facts

HOTEL_KEYS = ["ProductID", "checkin_date"]
DEST_KEYS = ["Destination", "checkin_date"]

FUNNEL_COLUMNS = [
    "ProductID", "checkin_date", "snapshot_at", "hotness_score", "trend_momentum",
    "Raw_Destination_Search", "view_volume", "Interval_Count", "ProductName",
    "Destination", "check_status", "Destination_Search_Snapshot",
    "Destination_Searches", "Destination_Intervals", "Bookings",
    "Internal_Worst_Gap", "Internal_Median_Gap", "Internal_Comparable_Rates",
    "Internal_Total_Rates", "Agoda_Raw_Gap", "Agoda_Price_Disadvantage",
    "Views_per_Search", "Search_to_Booking", "Internal_Comparable_Coverage",
    "Previous_Views", "Previous_View_Intervals", "Previous_Destination_Search_Snapshot",
    "Previous_Destination_Searches", "Previous_Destination_Intervals",
    "Comparable_View_Intervals", "Comparable_Views", "Previous_Comparable_Views",
    "Comparable_Destination_Intervals", "Comparable_Destination_Searches",
    "Previous_Comparable_Destination_Searches", "Destination_Search_Change",
    "View_Change", "Upload_Change_Status",
]


def coverage_change(df: DataFrame, value: str, intervals: str, prev_value: str, prev_intervals: str,
                    out_k: str, out_cur: str, out_prev: str) -> DataFrame:
    """k = min(intervals, previous intervals); values scaled to k intervals."""
    k = C.min_strict(intervals, prev_intervals)
    return df.withColumns(
        {
            out_k: k,
            out_cur: C.guarded_div(value, intervals) * k,
            out_prev: C.guarded_div(prev_value, prev_intervals) * k,
        }
    )


def upload_change_status(view_change: Column, previous_views: Column, status: Column) -> Column:
    """New / Up / Down / No change (the caller writes "No baseline" without one)."""
    return (
        F.when(previous_views.isNull() | C.flag(status == "new entry"), "New")
        .when(view_change > 0, "Up")
        .when(view_change < 0, "Down")
        .otherwise("No change")
    )


def hotel_date_funnel(
    current: DataFrame,
    baseline: DataFrame | None,
    bookings: DataFrame,
    internal: DataFrame,
    ota: DataFrame,
) -> DataFrame:
    """current hotel facts + destination searches + feeds + baseline change.

    ``current`` / ``baseline`` already carry their batch columns.
    """
    hotels = facts.hotel_checkin(current, batched=current).withColumnRenamed(
        "search_volume", "Raw_Destination_Search"
    )
    dest = facts.destination_checkin(current, batched=current)

    funnel = (
        hotels.join(bookings, on=HOTEL_KEYS, how="left")
        .join(internal.withColumnRenamed("stay_date", "checkin_date"), on=HOTEL_KEYS, how="left")
        .join(ota.withColumnRenamed("stay_date", "checkin_date"), on=HOTEL_KEYS, how="left")
        .withColumn("Bookings", F.coalesce("Bookings", F.lit(0.0)))
    )
    if baseline is not None:
        prev_hotels = facts.hotel_checkin(baseline, batched=baseline).select(
            *HOTEL_KEYS,
            F.col("view_volume").alias("Previous_Views"),
            F.col("Interval_Count").alias("Previous_View_Intervals"),
        )
        prev_dest = facts.destination_checkin(baseline, batched=baseline).select(
            *DEST_KEYS,
            F.col("Destination_Searches").alias("Previous_Destination_Searches"),
            F.col("Destination_Search_Snapshot").alias("Previous_Destination_Search_Snapshot"),
            F.col("Destination_Intervals").alias("Previous_Destination_Intervals"),
        )
        funnel = funnel.join(prev_hotels, on=HOTEL_KEYS, how="left")
        funnel = funnel.join(dest, on=DEST_KEYS, how="left").join(prev_dest, on=DEST_KEYS, how="left")
    else:
        funnel = funnel.join(dest, on=DEST_KEYS, how="left").withColumns(
            {
                "Previous_Views": F.lit(None).cast("double"),
                "Previous_View_Intervals": F.lit(None).cast("bigint"),
                "Previous_Destination_Searches": F.lit(None).cast("double"),
                "Previous_Destination_Search_Snapshot": F.lit(None).cast("timestamp_ntz"),
                "Previous_Destination_Intervals": F.lit(None).cast("bigint"),
            }
        )

    funnel = funnel.withColumns(
        {
            "Views_per_Search": C.ratio_if_positive("view_volume", "Destination_Searches"),
            "Search_to_Booking": C.ratio_if_positive("Bookings", "view_volume"),
            "Internal_Comparable_Coverage": C.ratio_if_positive(
                "Internal_Comparable_Rates", "Internal_Total_Rates"
            ),
        }
    )
    funnel = coverage_change(
        funnel, "view_volume", "Interval_Count", "Previous_Views", "Previous_View_Intervals",
        "Comparable_View_Intervals", "Comparable_Views", "Previous_Comparable_Views",
    )
    funnel = coverage_change(
        funnel, "Destination_Searches", "Destination_Intervals", "Previous_Destination_Searches",
        "Previous_Destination_Intervals", "Comparable_Destination_Intervals",
        "Comparable_Destination_Searches", "Previous_Comparable_Destination_Searches",
    )
    funnel = funnel.withColumns(
        {
            "Destination_Search_Change": F.col("Comparable_Destination_Searches")
            - F.col("Previous_Comparable_Destination_Searches"),
            "View_Change": F.col("Comparable_Views") - F.col("Previous_Comparable_Views"),
        }
    ).withColumn(
        "Upload_Change_Status",
        upload_change_status(F.col("View_Change"), F.col("Previous_Views"), F.col("check_status"))
        if baseline is not None
        else F.lit("No baseline"),
    )
    return funnel.select(*FUNNEL_COLUMNS)
