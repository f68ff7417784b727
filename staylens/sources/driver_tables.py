"""Derive the hotel-demand inputs from the driver's generic tables.

The driver ships TPC-H-like tables plus an ``events`` stream, not hotel
plain column expressions and small dimension joins, so every query grows
with the given tables.  The same mapping is written as SQL in
``staylens.oracle`` for the DuckDB cross-check.

Mapping (all rows of every table are used):

* demand row per event: snapshot_at = ts; checkin_date = day of ts + (event_id
  mod 14) days; ProductID = user_id (NULL for every 101st event);
  Destination = name of nation (user_id mod 25) (NULL for every 97th event);
  search_volume = value; view_volume = the number inside ``props``;
  hotness = views / 100 (NULL for every 13th event); trend spans
  -0.25..0.75; status from event_type; hotels are renamed after the 16th.
* the second load re-delivers every purchase event with one more view.
* previous = first load before 2024-01-20; latest = both loads.
* master = customer x nation x region; performance = orders; bookings = all
  purchase events; internal parity
  = lineitem; OTA parity = supplier pivoted over seven stay dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed values of the adapter (shared with the SQL oracle).
PREVIOUS_CUTOFF = "2024-01-20 00:00:00"
RENAME_FROM = "2024-01-16 00:00:00"
OTA_DATES = [
    "2024-01-24", "2024-01-25", "2024-01-26", "2024-01-27",
    "2024-01-28", "2024-01-29", "2024-01-30",
]
AGODA_BY_MOD5 = ["Mapped", "no room", "Not Live", " not mapped", None]
CTRIP_BY_MOD4 = ["Mapped", "Not Live", "Not Mapped", None]


_SCANS: dict[tuple[int, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One scan per table and session: reading a Parquet path infers its
    schema with a small job, and the adapter uses some tables many times."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark), spark.sparkContext.applicationId, path)
    if key not in _SCANS:
        _SCANS[key] = spark.read.parquet(path)
    return _SCANS[key]


def _demand_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    eid = F.col("event_id")
    views = F.regexp_extract("props", r"([0-9]+)", 1).try_cast("double")
    base = events.join(
        # 25 rows: a fixed-size dimension
        F.broadcast(nation),
        (F.col("user_id") % 25) == F.col("n_nationkey"),
        "left",
    )
    return base.select(
        F.col("ts").alias("snapshot_at"),
        F.date_add(F.to_date("ts"), (eid % 14).cast("int")).alias("checkin_date"),
        F.when(eid % 101 != 0, F.col("user_id")).alias("ProductID"),
        F.concat(
            F.lit("Hotel "),
            F.col("user_id").cast("string"),
            F.when(F.col("ts") >= F.lit(RENAME_FROM).cast("timestamp_ntz"), F.lit(" Resort"))
            .otherwise(F.lit("")),
        ).alias("ProductName"),
        F.when(eid % 97 != 0, F.col("n_name")).alias("Destination"),
        ((eid % 21 - 5) / 20.0).cast("double").alias("trend_momentum"),
        F.when(eid % 13 != 0, views / 100.0).alias("hotness_score"),
        F.when(F.col("event_type") == "signup", "new entry")
        .when(F.col("event_type") == "purchase", "modify")
        .otherwise("continues")
        .alias("check_status"),
        F.col("value").cast("double").alias("search_volume"),
        views.alias("view_volume"),
        F.col("event_type"),
        eid.alias("row_seq"),
    )


DEMAND_COLUMNS = [
    "snapshot_at", "checkin_date", "ProductID", "ProductName", "Destination",
    "trend_momentum", "hotness_score", "check_status", "search_volume",
    "view_volume", "load_seq", "row_seq",
]


def demand_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both loads: every event once, purchases a second time with +1 view."""
    loads = F.when(F.col("event_type") == "purchase", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = _demand_rows(spark, sf_dir).withColumn("load_seq", F.explode(loads))  # one scan for both
    return rows.withColumn("view_volume", F.col("view_volume") + F.col("load_seq")).select(*DEMAND_COLUMNS)


def demand_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First load, before the cut-off day: the retained older version."""
    rows = _demand_rows(spark, sf_dir)
    return (
        rows.where(F.col("snapshot_at") < F.lit(PREVIOUS_CUTOFF).cast("timestamp_ntz"))
        .withColumn("load_seq", F.lit(0))
        .select(*DEMAND_COLUMNS)
    )


def hotel_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_name"
    )
    return customer.join(F.broadcast(geo), customer.c_nationkey == geo.n_nationkey, "left").select(
        F.col("c_custkey").alias("ProductID"),
        F.col("c_name").alias("ProductName"),
        F.col("n_name").alias("Destination"),
        F.col("c_mktsegment").alias("HotelType Short"),
        F.col("r_name").alias("Region"),
        F.col("c_custkey").alias("row_seq"),
    )


def _status_by_mod(key, values) -> F.Column:
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string")
        expr = F.when(key % len(values) == i, lit) if expr is None else expr.when(key % len(values) == i, lit)
    return expr


def hotel_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_custkey")
    return orders.select(
        key.alias("ProductID"),
        F.concat(F.lit("Hotel "), key.cast("string")).alias("ProductName"),
        _status_by_mod(key, AGODA_BY_MOD5).alias("Agoda Status"),
        _status_by_mod(key, CTRIP_BY_MOD4).alias("Ctrip Status"),
        F.col("o_totalprice").cast("double").alias("Revenue"),
        (F.col("o_orderkey") % 40).cast("double").alias("B2B2C RN"),
        F.col("o_orderkey").alias("row_seq"),
    )


def booking_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw booking feed: one row per purchase."""
    rows = _demand_rows(spark, sf_dir).where(F.col("event_type") == "purchase")
    return rows.select(
        F.col("ProductID"),
        F.col("checkin_date").alias("CheckInDate"),
        (F.floor("search_volume") % 3 + 1).cast("double").alias("booking_count"),
    )


def internal_parity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw internal rate-parity feed; returned lines carry the '-' marker."""
    li = table(spark, sf_dir, "lineitem")
    gap = F.when(F.col("l_returnflag") == "R", F.lit("-")).otherwise(
        (F.col("l_tax") - F.col("l_discount")).cast("string")
    )
    return li.select(
        F.col("l_suppkey").alias("ProductID"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("l_orderkey") % 44).cast("int")).alias(
            "stayDate"
        ),
        gap.alias("Market Margin Gap"),
    )


def ota_parity_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide OTA parity sheet: hotel id, a name column, one column per stay date."""
    sup = table(spark, sf_dir, "supplier")
    cols = [F.col("s_suppkey").alias("Hotel Id"), F.col("s_name").alias("Hotel Name")]
    for k, day in enumerate(OTA_DATES):
        m = (F.col("s_suppkey") + k) % 6
        value = (
            F.when(m == 0, F.lit(None).cast("double"))
            .when(m == 1, F.lit(0.0))
            .otherwise(F.col("s_acctbal") / 1000.0 - 5.0)
        )
        cols.append(value.alias(day))
    return sup.select(*cols)


def destination_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates per destination (one per nation; 25 rows)."""
    nation = table(spark, sf_dir, "nation")
    return nation.select(
        F.col("n_name").alias("Destination"),
        (F.col("n_nationkey") * 0.5 + 5.0).cast("double").alias("Latitude"),
        (F.col("n_regionkey") * 2.0 + 98.0).cast("double").alias("Longitude"),
    )
