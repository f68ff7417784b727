"""A1 as a kept summary: observation batches of a store by day, brought up to date by reading changed days.

Beside a store's day files stand, per gap::

    batches/gap=<g>/v=<n>/day=<date>/       level 1 of that day: stamp, minute, run, run end
    minutes/gap=<g>/v=<n>/day=<date>/       one row per minute: first, last, gaps inside, end of the first run
    numbered/gap=<g>/n=<commit>/            the minutes of a commit with batch numbers and ends

A minute lies in one day, so level 1 of a day depends on no other day and is
as immutable as the day's rows: a commit adds it for the days it wrote and for
no others.  Level 2 is numbered again from the last batch break before the first
changed day: at that minute every earlier batch has ended, so earlier minutes
keep their numbers and ends, and later ones go on from its number.

``_SUCCESS`` files tell what is whole; a part that a crash left is written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from staylens.operators import batches
from staylens.plans.daystore import UNDATED, DayStore, Manifest
from staylens.sources.files import exists

STAMPS = "snapshot_at timestamp_ntz, _minute timestamp_ntz, _run long, _end timestamp_ntz"
MINUTES = "_minute timestamp_ntz, _lo timestamp_ntz, _hi timestamp_ntz, _n long, _head timestamp_ntz"
NUMBERED = "_minute timestamp_ntz, _n long, _off long, _head timestamp_ntz, _tail timestamp_ntz, _break boolean"


class BatchIndex:
    def __init__(self, store: DayStore, gap_seconds: int = 300):
        self.store, self.gap, self.spark = store, int(gap_seconds), store.spark

    def _folder(self, kind: str) -> str:
        return f"{self.store.folder}/{kind}/gap={self.gap}"

    def _whole(self, path: str) -> bool:
        return exists(self.spark, f"{path}/_SUCCESS")

    def _days(self, kind: str, manifest: Manifest, schema: str, since: str = "") -> DataFrame:
        paths = [f"{self._folder(kind)}/v={d['v']}/day={day}" for day, d in sorted(manifest.latest.items()) if day != UNDATED and day >= since]
        paths = [p for p in paths if exists(self.spark, p)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def pending(self, manifest: Manifest) -> list[int]:
        """Commits whose days have no level 1 yet."""
        held = {d["v"] for day, d in manifest.latest.items() if day != UNDATED}
        return sorted(v for v in held if not self._whole(f"{self._folder('minutes')}/v={v}"))

    def changed_rows(self, manifest: Manifest, version: int) -> DataFrame:
        """All that is read of the store for a commit: the stamps of the days it wrote."""
        days = {day for day, d in manifest.latest.items() if d["v"] == version and day != UNDATED}
        return self.store.read(manifest, "latest", days).select(batches.TS)

    def update(self) -> Manifest | None:
        """Level 1 of new days, then the numbers of the committed state; returns its manifest."""
        manifest = self.store.manifest()
        if manifest is None:
            return None
        for version in self.pending(manifest):
            distinct = self.changed_rows(manifest, version).where(F.col(batches.TS).isNotNull()).distinct()
            stamps, minutes = batches.minute_gaps(distinct, self.gap)
            for kind, table, at in (("batches", stamps, batches.TS), ("minutes", minutes, "_minute")):  # minutes last: they say that both are whole
                dated = table.withColumn("day", F.date_format(at, "yyyy-MM-dd"))
                dated.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{self._folder(kind)}/v={version}")
        target = f"{self._folder('numbered')}/n={manifest.number}"
        if not self._whole(target):
            self._number(manifest).write.mode("overwrite").parquet(target)
        return manifest

    def _number(self, manifest: Manifest) -> DataFrame:
        former, first = self._former(manifest)
        if former is None:
            return number(self._days("minutes", manifest, MINUTES), self.gap)
        return renumber(former, lambda since: self._days("minutes", manifest, MINUTES, since), first, self.gap)

    def _former(self, manifest: Manifest) -> tuple[DataFrame | None, str]:
        """The numbers of the newest earlier commit that has some, and the first day that differs from it."""
        for n in range(manifest.number - 1, 0, -1):
            path = f"{self._folder('numbered')}/n={n}"
            if self._whole(path):
                before = self.store._read_manifest(n).latest
                days = [d for d in manifest.latest.keys() | before.keys() if d != UNDATED and manifest.latest.get(d, {}).get("v") != before.get(d, {}).get("v")]
                return self.spark.read.schema(NUMBERED).parquet(path), min(days, default="9999-12-31")
        return None, ""

    def batch_map(self) -> DataFrame:
        """snapshot_at, Observation_Batch, Observation_At of the committed state, which ``update`` has numbered."""
        manifest = self.store.manifest()
        if manifest is None:
            raise FileNotFoundError(f"{self.store.folder} holds no rows")
        path = f"{self._folder('numbered')}/n={manifest.number}"
        if not self._whole(path):
            raise FileNotFoundError(f"commit {manifest.number} is not numbered yet; call update()")
        numbered = self.spark.read.schema(NUMBERED).parquet(path).drop("_break")
        return batches.join_minutes(self._days("batches", manifest, STAMPS), numbered)


def number(minutes: DataFrame, gap_seconds: int) -> DataFrame:
    """Numbered minutes, each with whether a batch begins in it."""
    numbered = batches.number_minutes(minutes, gap_seconds)
    # a minute opens a batch where its first stamp does (its offset has grown by one) or where a gap lies inside
    w = batches.Window.partitionBy().orderBy("_minute")
    last = F.lag(F.col("_off") + F.col("_n")).over(w)
    return numbered.withColumn("_break", (F.col("_n") > 0) | last.isNull() | (F.col("_off") > last))


def renumber(former: DataFrame, minutes_since, first_day: str, gap_seconds: int) -> DataFrame:
    """The numbered minutes of a history that differs from the former one from ``first_day`` on.

    ``minutes_since(day)`` gives the minutes of that day and later ones.
    """
    start = F.lit(first_day).cast("date").cast("timestamp_ntz")
    at = former.where(F.col("_break") & (F.col("_minute") < start)).agg(F.max(F.struct("_minute", "_off")).alias("x")).first().x
    if at is None:  # no batch began before
        return number(minutes_since(""), gap_seconds)
    since = F.lit(at._minute.isoformat(sep=" ")).cast("timestamp_ntz")
    again = minutes_since(at._minute.date().isoformat()).where(F.col("_minute") >= since)
    # the first of them begins batch 1 by itself; in the whole history it has the number it had
    again = number(again, gap_seconds).withColumn("_off", F.col("_off") + (at._off - 1))
    return former.where(F.col("_minute") < since).unionByName(again)
