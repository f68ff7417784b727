"""SRC5-SRC7: booking and price-parity feeds, pre-aggregated to one row per key.

Each feed is reduced to (ProductID, date) before it meets the funnel, so
join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from staylens.functions import columns as C

BOOKING_COLUMNS = ["ProductID", "checkin_date", "Bookings"]
INTERNAL_COLUMNS = [
    "ProductID", "stay_date", "Internal_Worst_Gap", "Internal_Median_Gap",
    "Internal_Comparable_Rates", "Internal_Total_Rates",
]
OTA_COLUMNS = ["ProductID", "stay_date", "Agoda_Raw_Gap", "Agoda_Price_Disadvantage"]


def bookings(raw: DataFrame) -> DataFrame:
    """SRC5: parse; drop NULL keys; sum ``booking_count`` (bad count = 0)."""
    rows = raw.select(
        C.as_long(raw, "ProductID").alias("ProductID"),
        C.as_date(raw, "CheckInDate").alias("checkin_date"),
        F.coalesce(C.as_double(raw, "booking_count"), F.lit(0.0)).alias("booking_count"),
    ).where(F.col("ProductID").isNotNull() & F.col("checkin_date").isNotNull())
    return rows.groupBy("ProductID", "checkin_date").agg(F.sum("booking_count").alias("Bookings"))


def internal_parity(raw: DataFrame) -> DataFrame:
    """SRC6: gap text, '-' and blank = NULL; min, median, count(non-NULL), rows."""
    if C._dtype(raw, "Market Margin Gap") == "string":
        text = F.trim(F.col("`Market Margin Gap`"))
        gap = C.to_double(F.when(~text.isin("-", ""), text))
    else:
        gap = C.as_double(raw, "Market Margin Gap")
    rows = raw.select(
        C.as_long(raw, "ProductID").alias("ProductID"),
        C.as_date(raw, "stayDate").alias("stay_date"),
        gap.alias("gap"),
    ).where(F.col("ProductID").isNotNull() & F.col("stay_date").isNotNull())
    return rows.groupBy("ProductID", "stay_date").agg(
        F.min("gap").alias("Internal_Worst_Gap"),
        F.median("gap").alias("Internal_Median_Gap"),
        F.count("gap").alias("Internal_Comparable_Rates"),
        F.count(F.lit(1)).alias("Internal_Total_Rates"),
    )


def date_columns(wide: DataFrame) -> list[str]:
    """Headers that parse as a calendar date (schema only, no job)."""
    import datetime as _dt

    out = []
    for name in wide.columns:
        try:
            _dt.date.fromisoformat(str(name)[:10])
        except ValueError:
            continue
        out.append(name)
    return out


def ota_parity(wide: DataFrame, id_column: str = "Hotel Id") -> DataFrame:
    """SRC7: unpivot date columns; min per key; disadvantage = max(-gap, 0), NULL kept."""
    dates = date_columns(wide)
    typed = wide.select(
        C.as_long(wide, id_column).alias("ProductID"),
        *[C.as_double(wide, d).alias(d) for d in dates],
    )
    long = typed.unpivot("ProductID", dates, "stay_text", "Agoda_Raw_Gap")
    long = long.select(
        "ProductID", F.to_date("stay_text").alias("stay_date"), "Agoda_Raw_Gap"
    ).where(F.col("ProductID").isNotNull() & F.col("stay_date").isNotNull())
    per_key = long.groupBy("ProductID", "stay_date").agg(F.min("Agoda_Raw_Gap").alias("Agoda_Raw_Gap"))
    return per_key.withColumn("Agoda_Price_Disadvantage", C.clip_floor0(-F.col("Agoda_Raw_Gap")))
