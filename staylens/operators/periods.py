"""choose the current window and an equally long baseline window.

* new rows = latest rows whose time stamp is absent from previous;
* with new rows: current = latest rows at or after the earliest new stamp,
  baseline source = previous (batched on its own);
* without: current = rows of the latest calendar day, baseline source =
  earlier rows of latest (batched with latest);
* baseline = the newest n batches of the source, n = batches in current.

Latest and previous are batched in one scoped batch map (each file on its
own, as required: latest may extend previous's last batch).  All
decisions are taken on that map (one row per distinct crawl stamp) and
become plain literals, so the row filters on the demand tables are pushed
down to the Parquet scan.  Batch ids are consecutive in time order, so
"newest n batches" is ``id > max_id - n`` and "batches in current" is
``max_id - min_id + 1`` over a time suffix: no global sort.  Both windows
are written in one job (partitioned by window) and read back.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from staylens.operators.batches import batch_map, with_batches
from staylens.operators.joins import join_small
from staylens.session import cut_lineage



@dataclass
class Periods:
    current: DataFrame  # rows with Observation_Batch / Observation_At
    baseline: DataFrame | None  # rows with their own batch ids; None when there is none
    current_start: object  # timestamp (Python) or None when latest is empty
    current_batches: int
    has_new: bool


def _ntz(value) -> F.Column:
    """A timestamp_ntz literal (a Python datetime would become a session-time-zone timestamp)."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _maps(latest: DataFrame, previous: DataFrame | None, gap_seconds: int) -> DataFrame:
    stamps = latest.select("snapshot_at", F.lit(1).alias("_src"))
    if previous is not None:
        stamps = stamps.unionByName(previous.select("snapshot_at", F.lit(0).alias("_src")))
    # read by each decision and by both windows: written once, so its shuffles are coalesced and nothing stays cached
    return cut_lineage(batch_map(stamps, gap_seconds, scope=["_src"]), "batch_maps")


def select_periods(latest: DataFrame, previous: DataFrame | None, gap_seconds: int = 300) -> Periods:
    TS, BATCH = F.col("snapshot_at"), F.col("Observation_Batch")
    maps = _maps(latest, previous, gap_seconds)
    cur_map = maps.where(F.col("_src") == 1).drop("_src")
    prev_map = maps.where(F.col("_src") == 0).drop("_src") if previous is not None else None

    # one job: per stamp, its batch in latest (lb) and in previous (pb)
    per_stamp = maps.groupBy("snapshot_at").agg(
        F.max(F.when(F.col("_src") == 1, BATCH)).alias("lb"),
        F.max(F.when(F.col("_src") == 0, BATCH)).alias("pb"),
    )
    is_new = F.col("lb").isNotNull() & F.col("pb").isNull()
    b = per_stamp.agg(
        F.max(F.when(F.col("lb").isNotNull(), TS)).alias("latest_hi"),
        F.min(F.when(is_new, TS)).alias("first_new"),
        F.min_by("lb", F.when(is_new, TS)).alias("first_new_batch"),
        F.max("lb").alias("latest_batch"),
        F.max("pb").alias("previous_batch"),
        F.count("pb").alias("previous_stamps"),
    ).first()
    if b["latest_hi"] is None:  # nothing with a time stamp
        return Periods(with_batches(latest, mapping=cur_map), None, None, 0, False)

    day_start = _dt.datetime.combine(b["latest_hi"].date(), _dt.time())
    has_new = b["previous_stamps"] > 0 and b["first_new"] is not None
    if has_new:
        current_start = b["first_new"]
        n = b["latest_batch"] - b["first_new_batch"] + 1
        newest = b["previous_batch"]
        source_rows, source_map = previous, prev_map
    else:
        current_start = day_start
        source_rows = latest.where(TS < _ntz(day_start))
        source_map = cur_map.where(TS < _ntz(day_start))
        r = cur_map.agg(
            F.min(F.when(TS >= _ntz(day_start), BATCH)).alias("lo"),
            F.max(F.when(TS < _ntz(day_start), BATCH)).alias("newest"),
        ).first()
        n = b["latest_batch"] - r["lo"] + 1
        newest = r["newest"]

    current = with_batches(
        latest.where(TS >= _ntz(current_start)),
        mapping=cur_map.where(TS >= _ntz(current_start)),
    )
    if newest is None:
        cut = cut_lineage(current, "current_window")
        return Periods(cut, None, current_start, n, has_new)

    picked = source_map.where(BATCH > F.lit(newest - n))
    span = picked.agg(F.min("snapshot_at").alias("lo"), F.max("snapshot_at").alias("hi")).first()
    # batch ends among the kept stamps (matters when a batch straddles the cut day)
    ends = picked.groupBy("Observation_Batch").agg(F.max("snapshot_at").alias("Observation_At"))
    mapping = join_small(picked.drop("Observation_At"), ends, on="Observation_Batch", how="inner")
    rows = source_rows.where((TS >= _ntz(span["lo"])) & (TS <= _ntz(span["hi"])))
    baseline = with_batches(rows, mapping=mapping)

    # both windows in one write, partitioned by window; each read back with pruning
    both = current.withColumn("_window", F.lit("current")).unionByName(
        baseline.withColumn("_window", F.lit("baseline"))
    )
    written = cut_lineage(both, "windows", partition_by="_window")
    cur = written.where(F.col("_window") == "current").drop("_window")
    base = written.where(F.col("_window") == "baseline").drop("_window")
    return Periods(cur, base, current_start, n, has_new)
