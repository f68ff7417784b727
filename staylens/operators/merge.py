"""Idempotent keyed upsert of a daily export into the demand history.

* upload rows without ProductID are skipped and counted;
* strict mode (the original behaviour) raises on an empty upload, on
  statuses outside {continues, new entry, modify} and on upload rows with an
  invalid key; ``strict=False`` quarantines such rows instead;
* key = (snapshot_at, checkin_date, ProductID); the later row wins
  (upload after history, then load / row order);
* history rows with an invalid key are all kept, never collapsed;
* ``data_changed`` is set-based: the upload changed something iff one of its
  keys is new or its winning row differs from the history's row for that
  key (the only keys a merge can touch).

The stats are one aggregate over a union of narrow tagged rows: one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from staylens.operators.clean import EVENT_KEY, VALID_CHECK_STATUSES
from staylens.operators.facts import latest_per_key

COMPARED = [
    "snapshot_at", "checkin_date", "ProductID", "ProductName", "Destination", "trend_momentum",
    "hotness_score", "check_status", "search_volume", "view_volume",
]


@dataclass
class MergeResult:
    merged: DataFrame
    stats: DataFrame  # one row
    quarantine: DataFrame | None = None


def _valid_key() -> F.Column:
    return F.col("snapshot_at").isNotNull() & F.col("checkin_date").isNotNull() & F.col("ProductID").isNotNull()


def _status_text() -> F.Column:
    return F.lower(F.trim(F.coalesce(F.col("check_status").cast("string"), F.lit(""))))


def check_upload(upload: DataFrame) -> dict:
    """One small job: the counters the strict checks need."""
    incoming = F.col("ProductID").isNotNull()
    bad_status = incoming & (_status_text() != "") & ~_status_text().isin(VALID_CHECK_STATUSES)
    row = upload.agg(
        F.count_if(incoming).alias("incoming"),
        F.count_if(incoming & ~_valid_key()).alias("invalid_keys"),
        F.count_if(bad_status).alias("bad_statuses"),
        F.min(F.when(bad_status, _status_text())).alias("first_bad_status"),
    ).first()
    return row.asDict()


def merge_incremental(history: DataFrame, upload: DataFrame, strict: bool = True) -> MergeResult:
    quarantine = None
    if strict:
        c = check_upload(upload)
        if c["incoming"] == 0:
            raise ValueError("no row of the upload has a ProductID, so nothing can be merged")
        if c["bad_statuses"]:
            raise ValueError(f"{c['bad_statuses']} upload rows have a check_status outside the allowed set, "
                             f"such as {c['first_bad_status']!r}; clean.invalid_statuses lists them all")
        if c["invalid_keys"]:
            raise ValueError(f"{c['invalid_keys']} upload rows have an unreadable Time Stamp, CheckInDate or ProductID")
        incoming = upload.where(F.col("ProductID").isNotNull())
    else:
        ok_status = (_status_text() == "") | _status_text().isin(VALID_CHECK_STATUSES)
        good = F.col("ProductID").isNotNull() & _valid_key() & ok_status
        incoming = upload.where(good)
        quarantine = upload.where(F.col("ProductID").isNotNull() & ~good)

    hist = history.withColumn("_src", F.lit(0))
    inc = incoming.withColumn("_src", F.lit(1))
    combined = hist.unionByName(inc, allowMissingColumns=True)
    winners = latest_per_key(combined.where(_valid_key()), EVENT_KEY, ["_src", "load_seq", "row_seq"])
    kept_invalid = hist.where(~_valid_key())  # legacy rows with a broken key are all kept
    merged = winners.unionByName(kept_invalid).drop("_src")

    # keys of the upload whose winner is new or differs from the history row
    h_rows = latest_per_key(hist.where(_valid_key()), EVENT_KEY, ["load_seq", "row_seq"])
    u_win = winners.where(F.col("_src") == 1)
    h_sel = h_rows.select(*EVENT_KEY, *[F.col(f"`{c}`").alias(f"_h_{c}") for c in COMPARED if c not in EVENT_KEY],
                          F.lit(True).alias("_in_h"))
    j = u_win.join(h_sel, on=EVENT_KEY, how="left")
    differs = F.col("_in_h").isNull()
    for c in COMPARED:
        if c not in EVENT_KEY:
            differs = differs | ~F.col(f"`{c}`").eqNullSafe(F.col(f"_h_{c}"))
    new_keys = j.where(F.col("_in_h").isNull())

    def tag(df: DataFrame, kind: str, ts: F.Column | None = None) -> DataFrame:
        return df.select(F.lit(kind).alias("_k"), (ts if ts is not None else F.lit(None)).cast("timestamp_ntz").alias("_t"))

    parts = (
        tag(history, "history")
        .unionByName(tag(upload, "upload"))
        .unionByName(tag(upload.where(F.col("ProductID").isNull()), "skipped"))
        .unionByName(tag(incoming, "incoming", F.col("snapshot_at")))
        .unionByName(tag(merged, "merged"))
        .unionByName(tag(new_keys, "new"))
        .unionByName(tag(j.where(differs), "changed"))
    )
    k = F.col("_k")
    stats = parts.agg(
        F.count_if(k == "history").alias("history_rows"),
        F.count_if(k == "upload").alias("uploaded_rows"),
        F.count_if(k == "skipped").alias("skipped_missing_product"),
        F.count_if(k == "new").alias("new_events"),
        (F.count_if(k == "history") + F.count_if(k == "incoming") - F.count_if(k == "merged")).alias(
            "duplicates_removed"
        ),
        F.count_if(k == "merged").alias("merged_rows"),
        (F.count_if(k == "changed") > 0).alias("data_changed"),
        F.min(F.when(k == "incoming", F.col("_t"))).alias("upload_min_timestamp"),
        F.max(F.when(k == "incoming", F.col("_t"))).alias("upload_max_timestamp"),
    )
    return MergeResult(merged, stats, quarantine)
