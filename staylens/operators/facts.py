"""Hotel and destination facts per check-in date.

Keep-last takes two passes and sorts nothing to aggregate.  The order
(snapshot_at, load_seq, row_seq), "sort, then keep the last row; ties keep input
key is a hash aggregate with a fixed-width buffer, combined map-side, so a hotel
or destination that holds a large share of the rows is reduced before the
shuffle; only keys and numbers move.  A semi-join then keeps the rows that reach
their key's maximum, and a key that is hot there is split by the adaptive
skew-join rule.  ``load_seq`` and ``row_seq`` name a row of its key, so one row
reaches it.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from staylens.functions.columns import sum0
from staylens.operators.batches import batch_map, with_batches
from staylens.operators.joins import join_small
from staylens.session import cut_lineage

HOTEL_KEYS = ["ProductID", "checkin_date"]
DEST_KEYS = ["Destination", "checkin_date"]
ORDER = ["snapshot_at", "load_seq", "row_seq"]


# Decimal digits of each order column in the packed order: stamps in microseconds reach the year 2286,
# row numbers those of a million partitions of 8e9 rows.
ORDER_DIGITS = {"snapshot_at": 16, "_src": 1, "load_seq": 5, "row_seq": 17}


def packed_order(order: Sequence[str]) -> Column:
    """The order columns as one number; NULL comes first in each, and a value that does not fit is an error."""
    total, shift = F.lit(0).cast("decimal(38,0)"), 0
    for name in reversed(order):
        digits = ORDER_DIGITS[name]
        if name == "snapshot_at":
            value = F.coalesce(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(name)), F.lit(1 - 10**15))
        else:
            value = F.coalesce(F.col(name).cast("long") + 1, F.lit(0))
        part = value.cast(f"decimal({digits},0)")
        total = total + (part * F.lit(Decimal(10**shift)) if shift else part)
        shift += digits
    if shift > 38:
        raise ValueError(f"{', '.join(order)} need {shift} digits, more than 38")
    total = total.cast("decimal(38,0)")
    return F.coalesce(total, F.raise_error(F.lit("an order column is out of range")).cast("decimal(38,0)"))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER, null_keys: bool = True) -> DataFrame:
    """The last row per key.

    NULL keys form one group, as in pandas; with ``null_keys=False`` the caller
    says that there are none, and the maxima are not shuffled again to be joined.
    """
    keys = list(keys)
    if not set(order) <= ORDER_DIGITS.keys():  # orders by other columns, of sheets with a row per hotel
        rest = [c for c in df.columns if c not in keys]
        picked = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[F.col(f"`{c}`") for c in order])).alias("_r")
        return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])
    rows = df.withColumn("_order", packed_order(order))
    top = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max("_order").alias("_top"))
    # at least the maximum: no more a join key than it must be, so the maxima stay where they were aggregated
    same = rows["_order"] >= top["_top"]
    for i, k in enumerate(keys):
        same = same & (rows[k].eqNullSafe(top[f"_k{i}"]) if null_keys else rows[k] == top[f"_k{i}"])
    return rows.join(top, same, "left_semi").drop("_order").select(*keys, *[c for c in df.columns if c not in keys])


def hotel_intervals(batched: DataFrame, scope: Sequence[str] = (), drop_null_dates: bool = True) -> DataFrame:
    """One row per (scope, batch, hotel, check-in date): the newest observation."""
    rows = batched.where(F.col("ProductID").isNotNull())
    if drop_null_dates:
        rows = rows.where(F.col("checkin_date").isNotNull())
    return latest_per_key(rows, [*scope, "Observation_Batch", *HOTEL_KEYS], null_keys=not drop_null_dates)


def hotel_checkin_from_intervals(intervals: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """A2 aggregation over deduplicated interval rows."""
    meta = F.max_by(
        F.struct("ProductName", "Destination", "check_status"), F.struct(*ORDER)
    ).alias("_m")
    return intervals.groupBy(*scope, *HOTEL_KEYS).agg(
        F.max("snapshot_at").alias("snapshot_at"),
        F.avg("hotness_score").alias("hotness_score"),
        F.avg("trend_momentum").alias("trend_momentum"),
        F.median("search_volume").alias("search_volume"),
        sum0("view_volume").alias("view_volume"),
        F.count(F.lit(1)).alias("Interval_Count"),
        meta,
    ).select(
        *scope, *HOTEL_KEYS, "snapshot_at", "hotness_score", "trend_momentum",
        "search_volume", "view_volume", "Interval_Count",
        "_m.ProductName", "_m.Destination", "_m.check_status",
    )


def hotel_checkin_views(intervals: DataFrame) -> DataFrame:
    """A2 without searches: no median is taken, so the newest row is found by its order, again without a sort.

    The maximum of the packed order is one more number of the hash aggregate;
    the interval row that reaches it is joined back for its names.
    """
    rows = intervals.withColumn("_order", packed_order(ORDER))
    numbers = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in HOTEL_KEYS]).agg(
        F.max("snapshot_at").alias("_at"),
        F.avg("hotness_score").alias("_hotness"),
        F.avg("trend_momentum").alias("_trend"),
        sum0("view_volume").alias("_views"),
        F.count(F.lit(1)).alias("Interval_Count"),
        F.max("_order").alias("_top"),
    )
    same = (F.col("ProductID") == F.col("_ProductID")) & (F.col("checkin_date") == F.col("_checkin_date"))
    return rows.join(numbers, same & (F.col("_order") >= F.col("_top"))).select(
        *HOTEL_KEYS, F.col("_at").alias("snapshot_at"), F.col("_hotness").alias("hotness_score"), F.col("_trend").alias("trend_momentum"),
        F.col("_views").alias("view_volume"), "Interval_Count", "ProductName", "Destination", "check_status",
    )


def hotel_checkin(
    demand: DataFrame,
    gap_seconds: int = 300,
    scope: Sequence[str] = (),
    batched: DataFrame | None = None,
) -> DataFrame:
    """A2: per hotel and check-in date over the given rows.

    Newest row per (batch, hotel, date); then max snapshot, mean hotness,
    mean trend, median destination search, summed views, number of
    batches, and name / destination / status of the newest row.
    """
    b = batched if batched is not None else with_batches(demand, gap_seconds, scope)
    return hotel_checkin_from_intervals(hotel_intervals(b, scope), scope)


def destination_checkin(
    demand: DataFrame,
    gap_seconds: int = 300,
    scope: Sequence[str] = (),
    batched: DataFrame | None = None,
) -> DataFrame:
    """A3: median search per (batch, destination, date), then summed per (destination, date)."""
    b = batched if batched is not None else with_batches(demand, gap_seconds, scope)
    per_batch = (
        b.where(F.col("Destination").isNotNull() & F.col("checkin_date").isNotNull())
        .groupBy(*scope, "Observation_Batch", "Observation_At", *DEST_KEYS)
        .agg(F.median("search_volume").alias("search_volume"))
    )
    return per_batch.groupBy(*scope, *DEST_KEYS).agg(
        F.max("Observation_At").alias("Destination_Search_Snapshot"),
        sum0("search_volume").alias("Destination_Searches"),
        F.count(F.lit(1)).alias("Destination_Intervals"),
    )


def stored_history_rows(latest: DataFrame, previous: DataFrame | None) -> DataFrame:
    """previous then latest; one row per event key, the later load winning."""
    frames = latest.withColumn("_src", F.lit(1))
    if previous is not None:
        frames = previous.withColumn("_src", F.lit(0)).unionByName(frames, allowMissingColumns=True)
    keyed = latest_per_key(frames, ["snapshot_at", "checkin_date", "ProductID"], ["_src", "load_seq", "row_seq"])
    return keyed.drop("_src")


def stored_history(
    latest: DataFrame, previous: DataFrame | None, gap_seconds: int = 300
) -> tuple[DataFrame, DataFrame]:
    """A4: all-history hotel and destination facts (re-batched on the union)."""
    rows = stored_history_rows(latest, previous)
    # read by both the hotel and the destination facts: written once, so it outlives a lost executor and holds no cache
    batched = cut_lineage(with_batches(rows, gap_seconds), "history_rows")
    hotels = hotel_checkin(rows, batched=batched).select(
        *HOTEL_KEYS,
        F.col("snapshot_at").alias("Last_Observed_At"),
        "hotness_score", "trend_momentum", "search_volume",
        F.col("view_volume").alias("Total_Observed_Views"),
        F.col("Interval_Count").alias("Historical_View_Intervals"),
        "ProductName", "Destination", "check_status",
    )
    destinations = destination_checkin(rows, batched=batched).select(
        *DEST_KEYS,
        F.col("Destination_Search_Snapshot").alias("Last_Observed_At"),
        F.col("Destination_Searches").alias("Total_Observed_Searches"),
        F.col("Destination_Intervals").alias("Historical_Search_Intervals"),
    )
    return hotels, destinations


def checkin_date_trend(demand: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """Searches (A3 rule) full-outer views (A2 dedupe) per destination and date.

    Rows need a time stamp, check-in date and destination; views are grouped
    by the destination on the kept row; NULL views count 0.
    """
    rows = demand.where(
        F.col("snapshot_at").isNotNull() & F.col("checkin_date").isNotNull() & F.col("Destination").isNotNull()
    ).withColumn("view_volume", F.coalesce("view_volume", F.lit(0.0)))
    b = with_batches(rows, gap_seconds)
    searches = destination_checkin(rows, batched=b).select(
        *DEST_KEYS, F.col("Destination_Searches").alias("Searches")
    )
    kept = hotel_intervals(b)
    views = kept.groupBy(*DEST_KEYS).agg(sum0("view_volume").alias("Views"))
    return searches.join(views, on=DEST_KEYS, how="full_outer")


def full_history_funnel(demand: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """A10: hotel x date facts over every stored row, with destination searches."""
    rows = demand.where(
        F.col("snapshot_at").isNotNull()
        & F.col("checkin_date").isNotNull()
        & F.col("ProductID").isNotNull()
        & F.col("Destination").isNotNull()
    ).withColumn("view_volume", F.coalesce("view_volume", F.lit(0.0)))
    rows = rows.withColumn("check_status", F.coalesce(F.lower(F.trim("check_status")), F.lit("unknown")))
    b = with_batches(rows, gap_seconds)
    hotels = hotel_checkin_views(hotel_intervals(b))
    # here the destination stamp is the newest row of the destination itself
    dest = (
        b.groupBy("Observation_Batch", *DEST_KEYS)
        .agg(F.median("search_volume").alias("s"), F.max("snapshot_at").alias("t"))
        .groupBy(*DEST_KEYS)
        .agg(
            sum0("s").alias("Destination_Searches"),
            F.max("t").alias("Destination_Search_Snapshot"),
            F.count(F.lit(1)).alias("Destination_Intervals"),
        )
    )
    return join_small(hotels, dest, on=DEST_KEYS, how="left")


def hotel_trend(demand: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """A11 bulk form: per hotel and check-in date, views and its destination's searches.

    The hotel's destination is its last non-NULL destination (input order);
    NULL searches count 0 before the median (unlike A3); batches are taken
    over all rows with a time stamp.
    """
    rows = demand.where(F.col("snapshot_at").isNotNull() & F.col("checkin_date").isNotNull()).withColumns(
        {
            "view_volume": F.coalesce("view_volume", F.lit(0.0)),
            "search_volume": F.coalesce("search_volume", F.lit(0.0)),
        }
    )
    mapping = batch_map(demand, gap_seconds)
    b = with_batches(rows, mapping=mapping)
    hotel_rows = b.where(F.col("ProductID").isNotNull())
    views = (
        latest_per_key(hotel_rows, ["Observation_Batch", "ProductID", "checkin_date"], null_keys=False)
        .groupBy("ProductID", "checkin_date")
        .agg(sum0("view_volume").alias("Hotel Views"))
    )
    placed = hotel_rows.where(F.col("Destination").isNotNull()).select("ProductID", "Destination", "load_seq", "row_seq")
    home = latest_per_key(placed, ["ProductID"], ["load_seq", "row_seq"], null_keys=False).select("ProductID", "Destination")
    dest_searches = (
        b.where(F.col("Destination").isNotNull())
        .groupBy("Observation_Batch", "Destination", "checkin_date")
        .agg(F.median("search_volume").alias("s"))
        .groupBy("Destination", "checkin_date")
        .agg(F.sum("s").alias("Destination Searches"))
    )
    hotel_dest_dates = join_small(home, dest_searches, on="Destination", how="inner").select(
        "ProductID", "checkin_date", "Destination Searches"
    )
    return hotel_dest_dates.join(views, on=["ProductID", "checkin_date"], how="full_outer")


def daily_history_trend(history_hotels: DataFrame, history_destinations: DataFrame) -> DataFrame:
    """Per date, summed stored searches full-outer summed stored views."""
    s = history_destinations.groupBy("checkin_date").agg(F.sum("Total_Observed_Searches").alias("Searches"))
    v = history_hotels.groupBy("checkin_date").agg(F.sum("Total_Observed_Views").alias("Views"))
    return s.join(v, on="checkin_date", how="full_outer")
