"""PRJ2-PRJ6: typing and cleaning of crawler demand rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from staylens.functions import columns as C

# The columns every demand export must carry, and the statuses
# an upload may use (blank is also allowed).
REQUIRED_DEMAND_COLUMNS = [
    "Time Stamp", "CheckInDate", "ProductID", "ProductName", "Destination",
    "trend_momentum", "hotness_score", "check_status", "search_volume",
    "view_volume",
]
VALID_CHECK_STATUSES = ["continues", "new entry", "modify"]
EVENT_KEY = ["snapshot_at", "checkin_date", "ProductID"]
NUMERIC_COLUMNS = ["trend_momentum", "hotness_score", "search_volume", "view_volume"]


def require_columns(df: DataFrame, required=REQUIRED_DEMAND_COLUMNS, label: str = "Demand") -> None:
    """SRC4: fail naming the missing columns, sorted (schema only, no job)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{label} is missing required columns: {', '.join(missing)}")


def type_demand(landed: DataFrame) -> DataFrame:
    """Type a landed (all-text) demand export; extra columns are carried."""
    extra = [c for c in landed.columns if c not in REQUIRED_DEMAND_COLUMNS]
    typed = [
        C.parse_timestamp("`Time Stamp`").alias("snapshot_at"),
        C.parse_date("CheckInDate").alias("checkin_date"),
        C.to_long("ProductID").alias("ProductID"),
        C.clean_text("ProductName").alias("ProductName"),
        C.clean_text("Destination").alias("Destination"),
        *[C.to_double(c).alias(c) for c in NUMERIC_COLUMNS],
        C.clean_text("check_status").alias("check_status"),
    ]
    return landed.select(*typed, *[F.col(f"`{c}`") for c in extra])


def prepare_demand(demand: DataFrame) -> DataFrame:
    """PRJ2: status lower/trim (NULL -> 'unknown'); drop rows without ID or name."""
    return demand.withColumn("check_status", C.demand_status("check_status")).where(
        F.col("ProductID").isNotNull() & F.col("ProductName").isNotNull()
    )


def load_demand(demand: DataFrame) -> DataFrame:
    """PRJ3: the light variant used by the comparison views: no row dropped."""
    return demand


def split_invalid(demand: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PRJ6: rows with a full event key, and the quarantine of the others."""
    valid = F.col("snapshot_at").isNotNull() & F.col("checkin_date").isNotNull() & F.col("ProductID").isNotNull()
    return demand.where(valid), demand.where(~valid)


def invalid_statuses(upload: DataFrame) -> DataFrame:
    """PRJ5: distinct non-blank upload statuses outside the allowed set."""
    s = F.lower(F.trim(F.coalesce(F.col("check_status").cast("string"), F.lit(""))))
    return (
        upload.select(s.alias("check_status"))
        .where(F.col("check_status") != "")
        .where(~F.col("check_status").isin(VALID_CHECK_STATUSES))
        .distinct()
    )
