"""A1 observation batches: global gap sessionisation of crawl time stamps.

Distinct time stamps, sorted; a new batch starts when the gap to the
previous distinct time stamp is greater than ``gap_seconds`` (a gap of
exactly ``gap_seconds`` stays in the batch).  Batch ids count from 1 within
each ``scope`` (for example a target week); ``Observation_At`` is the
newest time stamp of the batch among the rows that were batched.

A single window ordered over all time stamps would run in one task.  The
scan has two levels whose window partitions are bounded by construction

1. per (scope, minute): gap flags and a running count, at most one row per
   distinct microsecond (<= 6e7 narrow rows);
2. per scope: one row per non-empty minute (<= 525,600 a year), with the
   number of batches begun before it and the ends of the batches that its
   first and last stamps are in.

batch = batches begun before the minute + running count within it.  A gap
that crosses a minute is measured between the last stamp of the previous
non-empty minute and the first of this one, so the result equals the
single-window form for any gap.  A batch within a minute ends at the last
stamp of its running count; one that crosses minutes ends where level 2
finds the next gap.  So nothing the size of the stamps is aggregated by batch
or joined but for the minute table, and no level is cached: both readers of
level 1 share its exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from staylens.operators.joins import join_small

TS = "snapshot_at"


def _gap_exceeded(later: Column, earlier: Column, gap_seconds: int) -> Column:
    # timestamp_ntz difference is a day-time interval: no time-zone shift,
    # no cast to double (an error for timestamp_ntz).
    return (later - earlier) > F.expr(f"INTERVAL '{int(gap_seconds)}' SECOND")


def batch_map(df: DataFrame, gap_seconds: int = 300, scope: Sequence[str] = (), ts: str = TS) -> DataFrame:
    """One row per (scope, distinct time stamp) with Observation_Batch / Observation_At."""
    scope = list(scope)
    distinct = df.where(F.col(ts).isNotNull()).select(*scope, ts).distinct()
    return number_batches(distinct, gap_seconds, scope, ts)


def minute_gaps(distinct: DataFrame, gap_seconds: int, scope: Sequence[str] = (), ts: str = TS) -> tuple[DataFrame, DataFrame]:
    """Level 1: stamps with their running gap count and run end, and the summary of each minute.

    The summary (``_lo``, ``_hi``, ``_n`` gaps inside, ``_head`` end of the first
    run) is all that other minutes need, so it can be stored and read again.
    """
    minute = [*scope, "_minute"]
    w = Window.partitionBy(*minute).orderBy(ts)
    prev = F.lag(ts).over(w)
    stamps = distinct.withColumn("_minute", F.date_trunc("minute", ts).cast("timestamp_ntz"))
    stamps = stamps.withColumn("_flag", F.when(prev.isNotNull() & _gap_exceeded(F.col(ts), prev, gap_seconds), 1).otherwise(0))
    stamps = stamps.withColumn("_run", F.sum("_flag").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    minutes = stamps.groupBy(*minute).agg(
        F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.sum("_flag").alias("_n"), F.max(F.when(F.col("_run") == 0, F.col(ts))).alias("_head")
    )
    stamps = stamps.withColumn("_end", F.max(ts).over(Window.partitionBy(*minute, "_run"))).drop("_flag")
    return stamps, minutes


def number_minutes(minutes: DataFrame, gap_seconds: int, scope: Sequence[str] = ()) -> DataFrame:
    """Level 2: per minute the batches begun before it (``_off``) and the ends of its first and last batch."""
    w = Window.partitionBy(*scope).orderBy("_minute")
    back = Window.partitionBy(*scope).orderBy(F.col("_minute").desc())
    prev, following = F.lag("_hi").over(w), F.lag("_lo").over(back)
    first = prev.isNull() | _gap_exceeded(F.col("_lo"), prev, gap_seconds)
    last = following.isNull() | _gap_exceeded(following, F.col("_hi"), gap_seconds)
    m = minutes.withColumns({"_first": first.cast("int"), "_last": last})
    m = m.withColumn("_off", F.sum(F.col("_n") + F.col("_first")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    # where the batch of a minute's last stamp ends: here, in the first run of the next minute, or past it
    head = F.when(F.col("_n") > 0, F.col("_head"))
    close = F.when(F.col("_last"), F.col("_hi")).otherwise(F.lag(head).over(back))
    m = m.withColumn("_close", close)
    tail = F.last("_close", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumn("_tail", tail)
    return m.select(*scope, "_minute", "_n", "_off", F.coalesce(head, "_tail").alias("_head"), "_tail")


def number_batches(distinct: DataFrame, gap_seconds: int, scope: Sequence[str] = (), ts: str = TS) -> DataFrame:
    """Both levels over distinct stamps."""
    stamps, minutes = minute_gaps(distinct, gap_seconds, scope, ts)
    return join_minutes(stamps, number_minutes(minutes, gap_seconds, scope), scope, ts)


def join_minutes(stamps: DataFrame, numbered: DataFrame, scope: Sequence[str] = (), ts: str = TS) -> DataFrame:
    """Batch ids and ends of the stamps of level 1 from the numbered minutes."""
    rows = join_small(stamps, numbered, on=[*scope, "_minute"], how="inner")
    at = F.when(F.col("_run") == F.col("_n"), F.col("_tail")).when(F.col("_run") == 0, F.col("_head")).otherwise(F.col("_end"))
    return rows.select(
        *scope, ts, (F.col("_off") + F.col("_run")).cast("bigint").alias("Observation_Batch"), at.alias("Observation_At")
    )


def with_batches(
    df: DataFrame,
    gap_seconds: int = 300,
    scope: Sequence[str] = (),
    ts: str = TS,
    mapping: DataFrame | None = None,
) -> DataFrame:
    """Attach Observation_Batch / Observation_At to every row with a time stamp.

    Rows without a time stamp are dropped, as the batching step does in the
    original tool.  ``mapping`` lets callers reuse one computed batch map.
    Adaptive execution picks the join from the map's measured size.
    """
    scope = list(scope)
    if mapping is None:
        mapping = batch_map(df, gap_seconds, scope, ts)
    rows = df.drop("Observation_Batch", "Observation_At").where(F.col(ts).isNotNull())
    return join_small(rows, mapping, on=[*scope, ts], how="inner")
