"""Data-quality counters and reconciliation of published tables.

Every check returns a small DataFrame (one row per check), so the audit
runs as a Spark job and its result can be published or asserted on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from staylens.functions import columns as C
from staylens.operators import facts

TOLERANCE = 1e-6
MASTER_CHECK_COLUMNS = ["ProductName", "Destination", "Region", "HotelType Short", "Agoda Status", "Ctrip Status"]


def raw_key_quality(raw: DataFrame) -> DataFrame:
    """Invalid time stamps / check-in dates / product ids; duplicate event keys (NULL = NULL)."""
    keys = F.struct("snapshot_at", "checkin_date", "ProductID")  # a struct with NULL fields is a value
    return raw.agg(
        F.count_if(F.col("snapshot_at").isNull()).alias("invalid_timestamp_rows"),
        F.count_if(F.col("checkin_date").isNull()).alias("invalid_checkin_rows"),
        F.count_if(F.col("ProductID").isNull()).alias("missing_product_rows"),
        (F.count(F.lit(1)) - F.count_distinct(keys)).alias("duplicate_event_keys"),
    )


def _text(name: str) -> F.Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("<NA>"))


def master_conflicts(master: DataFrame) -> DataFrame:
    """Ids listed more than once, and those whose attributes disagree (NULL is a value)."""
    cols = [c for c in MASTER_CHECK_COLUMNS if c in master.columns]
    per_id = (
        master.where(F.col("ProductID").isNotNull())
        .groupBy("ProductID")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[x for i, c in enumerate(cols) for x in (F.min(_text(c)).alias(f"_a{i}"), F.max(_text(c)).alias(f"_z{i}"))],
        )
        .where(F.col("_n") > 1)
    )
    conflict = F.lit(False)
    for i in range(len(cols)):
        conflict = conflict | (F.col(f"_a{i}") != F.col(f"_z{i}"))
    return per_id.agg(
        F.count(F.lit(1)).alias("duplicate_ids"), F.count_if(conflict).alias("conflicting_ids")
    )


def search_conflicts(batched: DataFrame) -> DataFrame:
    """(batch, destination, date) groups holding more than one search value."""
    groups = (
        batched.where(F.col("Destination").isNotNull() & F.col("checkin_date").isNotNull())
        .groupBy("Observation_Batch", "Destination", "checkin_date")
        .agg(F.min("search_volume").alias("_a"), F.max("search_volume").alias("_z"))
    )
    return groups.agg(F.count_if(F.col("_a") != F.col("_z")).alias("inconsistent_search_groups"))


def batch_sizes(batched: DataFrame) -> DataFrame:
    """Rows per observation batch: min / median / max."""
    per = batched.groupBy("Observation_Batch").agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(
        F.min("_n").alias("min_rows"), F.median("_n").alias("median_rows"), F.max("_n").alias("max_rows"),
        F.count(F.lit(1)).alias("batches"),
    )


def reconcile(
    name: str, expected: DataFrame, actual: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """A20 building block: full-outer compare on keys; |difference| > 1e-6 is a mismatch.

    A key missing on one side counts once (in missing_in_*), not again as a
    value difference; NULL on both sides is equal.
    """
    e = expected.select(*keys, *[F.col(v).alias(f"_e_{v}") for v in values], F.lit(True).alias("_in_e"))
    a = actual.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in values], F.lit(True).alias("_in_a"))
    j = e.join(a, on=list(keys), how="full_outer")
    both = F.col("_in_e").isNotNull() & F.col("_in_a").isNotNull()
    differs = F.lit(False)
    for v in values:
        d = F.abs(F.col(f"_e_{v}") - F.col(f"_a_{v}"))
        one_null = F.col(f"_e_{v}").isNull() != F.col(f"_a_{v}").isNull()
        differs = differs | C.flag(d > TOLERANCE) | one_null
    out = j.agg(
        F.count(F.lit(1)).alias("compared_keys"),
        F.count_if(F.col("_in_a").isNull()).alias("missing_in_actual"),
        F.count_if(F.col("_in_e").isNull()).alias("missing_in_expected"),
        F.count_if(both & differs).alias("value_different"),
    )
    return out.select(
        F.lit(name).alias("check"), "*",
        ((F.col("missing_in_actual") + F.col("missing_in_expected") + F.col("value_different")) == 0).alias("passed"),
    )


def expected_hotel_changes(current: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """Recomputed hotel views and coverage-matched views of the current window."""
    h = facts.hotel_checkin(current, batched=current)
    if baseline is None:
        return h.select("ProductID", "checkin_date", "view_volume",
                        F.lit(None).cast("double").alias("Comparable_Views"),
                        F.lit(None).cast("double").alias("Previous_Comparable_Views"))
    p = facts.hotel_checkin(baseline, batched=baseline).select(
        "ProductID", "checkin_date", F.col("view_volume").alias("_pv"), F.col("Interval_Count").alias("_pi")
    )
    j = h.join(p, on=["ProductID", "checkin_date"], how="left")
    k = C.min_strict("Interval_Count", "_pi")
    return j.select(
        "ProductID", "checkin_date", "view_volume",
        (F.col("view_volume") / F.col("Interval_Count") * k).alias("Comparable_Views"),
        (F.col("_pv") / F.col("_pi") * k).alias("Previous_Comparable_Views"),
    )


def expected_destination_changes(current: DataFrame, baseline: DataFrame | None) -> DataFrame:
    d = facts.destination_checkin(current, batched=current)
    if baseline is None:
        return d.select("Destination", "checkin_date", "Destination_Searches",
                        F.lit(None).cast("double").alias("Comparable_Destination_Searches"),
                        F.lit(None).cast("double").alias("Previous_Comparable_Destination_Searches"))
    p = facts.destination_checkin(baseline, batched=baseline).select(
        "Destination", "checkin_date", F.col("Destination_Searches").alias("_ps"),
        F.col("Destination_Intervals").alias("_pi"),
    )
    j = d.join(p, on=["Destination", "checkin_date"], how="left")
    k = C.min_strict("Destination_Intervals", "_pi")
    return j.select(
        "Destination", "checkin_date", "Destination_Searches",
        (F.col("Destination_Searches") / F.col("Destination_Intervals") * k).alias("Comparable_Destination_Searches"),
        (F.col("_ps") / F.col("_pi") * k).alias("Previous_Comparable_Destination_Searches"),
    )


def audit(
    current: DataFrame,
    baseline: DataFrame | None,
    funnel: DataFrame,
    history_expected: tuple[DataFrame, DataFrame],
    history_published: tuple[DataFrame, DataFrame],
) -> DataFrame:
    """One row per check; ``passed`` false marks a hard failure."""
    dest_cols = ["Destination_Searches", "Comparable_Destination_Searches", "Previous_Comparable_Destination_Searches"]
    published_dest = funnel.where(F.col("Destination").isNotNull()).groupBy("Destination", "checkin_date").agg(
        *[F.max(c).alias(c) for c in dest_cols]
    )
    hotel_cols = ["view_volume", "Comparable_Views", "Previous_Comparable_Views"]
    checks = [
        reconcile("destination_searches", expected_destination_changes(current, baseline), published_dest,
                  ["Destination", "checkin_date"], dest_cols),
        reconcile("hotel_views", expected_hotel_changes(current, baseline), funnel,
                  ["ProductID", "checkin_date"], hotel_cols),
        reconcile("history_destinations", history_expected[1], history_published[1],
                  ["Destination", "checkin_date"], ["Total_Observed_Searches"]),
        reconcile("history_hotels", history_expected[0], history_published[0],
                  ["ProductID", "checkin_date"], ["Total_Observed_Views"]),
    ]
    ids = current.select(F.lit(True).alias("_cur"), "Observation_Batch")
    if baseline is not None:
        ids = ids.unionByName(baseline.select(F.lit(False).alias("_cur"), "Observation_Batch"))
    counted = ids.agg(
        F.count_distinct(F.when(F.col("_cur"), F.col("Observation_Batch"))).alias("n"),
        F.count_distinct(F.when(~F.col("_cur"), F.col("Observation_Batch"))).alias("m"),
    )
    windows = counted.select(
        F.lit("window_batches").alias("check"),
        F.col("n").alias("compared_keys"),
        F.lit(0).cast("bigint").alias("missing_in_actual"),
        F.lit(0).cast("bigint").alias("missing_in_expected"),
        F.abs(F.col("n") - F.col("m")).cast("bigint").alias("value_different"),
        (F.col("n") == F.col("m")).alias("passed"),
    )
    out = windows
    for c in checks:
        out = out.unionByName(c)
    return out
