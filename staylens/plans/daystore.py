"""SNK4 / F5 by affected day: the demand history as immutable files per day and one pointer.

Layout of a store folder::

    days/v=<n>/day=<date>/*.parquet   rows of one day of crawl stamps, as commit n wrote them
    manifests/<n>.json                which v holds each day, for latest and previous, and the outputs
    quarantine/v=<n>/*.parquet        rows of a lenient merge that could not be merged, with the reason

An upload touches the days of its own stamps only: the event key contains the
stamp, so no other day can change.  Those days are read, merged and compared;
days whose winners all equal what is stored are left alone too.  The rest is
written under a new ``v`` with dynamic partition overwrite, so a second attempt
at the same commit replaces what a lost one left behind.  No file of another
day is read or written, whatever the length of the history.

A commit is one renamed manifest.  It names the day files of ``latest``, those
of ``previous`` (the former ``latest``: a pointer, not a copy), the published
outputs and the last epoch of each stream, so a crash leaves all of them old or
all of them new.  Counts of rows per day stand in it as well, so totals need no
scan.  A manifest has one entry per calendar day.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from staylens.operators.clean import EVENT_KEY, VALID_CHECK_STATUSES
from staylens.operators.merge import COMPARED
from staylens.session import cut_lineage, discard
from staylens.sources.files import _fs, exists

UNDATED = "__HIVE_DEFAULT_PARTITION__"  # the folder name of rows without a stamp
DATE = "yyyy-MM-dd"


@dataclass
class Manifest:
    number: int = 0
    latest: dict[str, dict] = field(default_factory=dict)  # day -> {"v": commit, "rows": count}
    previous: dict[str, dict] | None = None
    schema: dict | None = None
    last_load: int = 0
    outputs: str | None = None
    epochs: dict[str, int] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(d["rows"] for d in self.latest.values())


@dataclass
class Staged:
    """A merge whose files are written and whose manifest is not."""

    stats: dict
    manifest: Manifest | None  # None: the upload changes nothing
    quarantined: int = 0


class DayStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # ---- manifests

    def _manifests(self) -> list[int]:
        fs, path = _fs(self.spark, f"{self.folder}/manifests")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read_manifest(self, number: int) -> Manifest:
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.folder}/manifests/{number:010d}.json").collect())
        return Manifest(**json.loads(text))

    def manifest(self) -> Manifest | None:
        """The committed state; None for a store that holds nothing."""
        numbers = self._manifests()
        return self._read_manifest(numbers[-1]) if numbers else None

    def commit(self, manifest: Manifest) -> None:
        """Make ``manifest`` the state of the store: written aside, then renamed in one step."""
        fs, aside = _fs(self.spark, f"{self.folder}/manifests/_{manifest.number:010d}.json.part")
        _, target = _fs(self.spark, f"{self.folder}/manifests/{manifest.number:010d}.json")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest.__dict__, sort_keys=True).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(aside, target):
            raise RuntimeError(f"commit {manifest.number} of {self.folder} was made by another writer")

    # ---- rows

    def _rows(self, days: dict[str, dict], schema: dict | None) -> DataFrame | None:
        if not days or schema is None:
            return None
        paths = [f"{self.folder}/days/v={d['v']}/day={day}" for day, d in sorted(days.items())]
        kinds = StructType.fromJson(schema)
        # partition columns by name, so a folder's day is never guessed to be of another type
        kinds = StructType([*kinds.fields, StructField("v", StringType()), StructField("day", StringType())])
        return self.spark.read.schema(kinds).option("basePath", f"{self.folder}/days").parquet(*paths).drop("v", "day")

    def read(self, manifest: Manifest | None, which: str = "latest", days: set[str] | None = None) -> DataFrame | None:
        """The rows of ``latest`` or ``previous``, of some days or of all; None where there are none."""
        if manifest is None:
            return None
        held = getattr(manifest, which) or {}
        return self._rows({d: x for d, x in held.items() if days is None or d in days}, manifest.schema)

    # ---- merging

    def stage(self, upload: DataFrame, strict: bool = True, stream: str | None = None, epoch: int | None = None) -> Staged:
        """Merge an upload into the days it touches and write those that change; nothing is committed."""
        now = self.manifest() or Manifest()
        number = now.number + 1
        # numbered after everything stored; loads within the upload keep their order
        within = F.coalesce("load_seq", F.lit(0)) if "load_seq" in upload.columns else F.lit(0)
        upload = upload.withColumn("load_seq", (within + (now.last_load + 1)).cast("int")).withColumns({"day": _day(), "_fault": _fault()})
        upload = cut_lineage(upload, "upload")  # read three times below; what came is small beside what is stored

        found = upload.groupBy("day", "_fault").agg(
            F.count("*").alias("n"), F.min("snapshot_at").alias("lo"), F.max("snapshot_at").alias("hi"),
            F.min(F.when(F.col("_fault") == "unsupported status", _status())).alias("status"), F.max("load_seq").alias("load"),
        ).collect()
        counts = {f: sum(r.n for r in found if r["_fault"] == f) for f in FAULTS}
        if strict:
            _raise(counts, [r.status for r in found if r.status is not None])
        load = max((r.load for r in found), default=now.last_load)
        good = [r for r in found if r["_fault"] == "none"]
        days = {r.day for r in good}
        quarantined = counts["invalid key"] + counts["unsupported status"]
        if quarantined:
            bad = upload.where(F.col("_fault").isin("invalid key", "unsupported status")).withColumnRenamed("_fault", "reason").drop("day")
            bad.write.mode("overwrite").parquet(f"{self.folder}/quarantine/v={number}")

        incoming = upload.where("_fault = 'none'").drop("_fault", "day")
        stored = self.read(now, "latest", days)
        merged = cut_lineage(_merge_days(stored, incoming), "days", partition_by="day")
        per_day = {
            r.day: r
            for r in merged.groupBy(F.coalesce(F.col("day").cast("string"), F.lit(UNDATED)).alias("day")).agg(
                F.count("*").alias("rows"), F.sum("_stored").alias("stored"), F.count_if("_new").alias("new"), F.count_if("_changed").alias("changed")
            ).collect()
        }
        changed = [d for d, r in per_day.items() if r.changed]
        total = now.rows - sum(r.stored for r in per_day.values()) + sum(r.rows for r in per_day.values())
        stats = {
            "history_rows": now.rows,
            "uploaded_rows": sum(r.n for r in found),
            "skipped_missing_product": counts["no product"],
            "new_events": sum(r.new for r in per_day.values()),
            "duplicates_removed": now.rows + counts["none"] - total,
            "merged_rows": total,
            "data_changed": bool(changed),
            "upload_min_timestamp": min((r.lo for r in good), default=None),
            "upload_max_timestamp": max((r.hi for r in good), default=None),
        }
        epochs = dict(now.epochs) | ({stream: epoch} if stream is not None else {})
        manifest = None
        if changed:
            rows = merged.where(F.col("day").cast("string").isin(changed)).drop("_stored", "_new", "_changed")
            files = rows.repartition("day", F.pmod(F.xxhash64(*EVENT_KEY), F.lit(_files(per_day, changed))))
            files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.folder}/days/v={number}")
            held = dict(now.latest) | {d: {"v": number, "rows": per_day[d].rows} for d in changed}
            schema = rows.drop("day").schema.jsonValue()
            manifest = Manifest(number, held, dict(now.latest) or None, schema, load, now.outputs, epochs)
        elif stream is not None or quarantined:
            # the epoch is done and the load number used, though no row changed
            manifest = Manifest(number, now.latest, now.previous, now.schema, load, now.outputs, epochs)
        discard(upload, merged)
        return Staged(stats, manifest, quarantined)

    def quarantine(self) -> DataFrame | None:
        """All rows set aside by committed merges, with ``reason`` and the commit ``v``."""
        folder, now = f"{self.folder}/quarantine", self.manifest()
        if now is None or not exists(self.spark, folder):
            return None
        return self.spark.read.option("mergeSchema", True).parquet(folder).where(F.col("v") <= now.number)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete day folders that none of the newest ``keep`` manifests names; returns their paths."""
        numbers = self._manifests()
        used = set()
        for number in numbers[-keep:]:
            m = self._read_manifest(number)
            used |= {(d["v"], day) for held in (m.latest, m.previous or {}) for day, d in held.items()}
        gone = []
        fs, root = _fs(self.spark, f"{self.folder}/days")
        for version in fs.listStatus(root) if fs.exists(root) else ():
            v = int(version.getPath().getName()[2:])
            if numbers and v > numbers[-1]:
                continue  # being written
            for day in fs.listStatus(version.getPath()):
                name = day.getPath().getName()
                if name.startswith("day=") and (v, name[4:]) not in used:
                    fs.delete(day.getPath(), True)
                    gone.append(f"v={v}/{name}")
        return sorted(gone)


FAULTS = ["none", "no product", "invalid key", "unsupported status"]
ROWS_PER_FILE = 2_000_000


def _files(per_day: dict, changed: list[str]) -> int:
    """Files per day folder: one, and more where a day is large."""
    return max(1, -(-max(per_day[d].rows for d in changed) // ROWS_PER_FILE))


def _day() -> F.Column:
    return F.coalesce(F.date_format("snapshot_at", DATE), F.lit(UNDATED))


def _status() -> F.Column:
    return F.lower(F.trim(F.coalesce(F.col("check_status").cast("string"), F.lit(""))))


def _fault() -> F.Column:
    key = F.col("snapshot_at").isNotNull() & F.col("checkin_date").isNotNull()
    return (
        F.when(F.col("ProductID").isNull(), "no product")
        .when(~key, "invalid key")
        .when((_status() != "") & ~_status().isin(VALID_CHECK_STATUSES), "unsupported status")
        .otherwise("none")
    )


def _raise(counts: dict[str, int], statuses: list[str]) -> None:
    if counts["none"] + counts["invalid key"] + counts["unsupported status"] == 0:
        raise ValueError("no row of the upload has a ProductID, so nothing can be merged")
    if counts["unsupported status"]:
        raise ValueError(f"{counts['unsupported status']} upload rows have a check_status outside the allowed set, such as {min(statuses)!r}")
    if counts["invalid key"]:
        raise ValueError(f"{counts['invalid key']} upload rows have an unreadable Time Stamp, CheckInDate or ProductID")


def _merge_days(stored: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Winners of the touched days with ``day``, ``_stored`` (rows they replace), ``_new`` and ``_changed``.

    One aggregation gives the winner, the stored row it may replace and the
    counts; it is combined map-side.  Stored rows with a broken key are kept.
    """
    incoming = incoming.withColumn("_src", F.lit(1))
    both = incoming if stored is None else stored.withColumn("_src", F.lit(0)).unionByName(incoming, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*EVENT_KEY, "_src")]
    compared = [c for c in COMPARED if c not in EVENT_KEY]
    valid = F.col("snapshot_at").isNotNull() & F.col("checkin_date").isNotNull() & F.col("ProductID").isNotNull()
    old = F.when(F.col("_src") == 0, F.struct("load_seq", "row_seq"))
    won = both.where(valid).groupBy(*EVENT_KEY).agg(
        F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct("_src", "load_seq", "row_seq")).alias("_w"),
        F.max_by(F.struct(*compared), old).alias("_o"),
        F.count_if(F.col("_src") == 0).alias("_stored"),
        F.max("_src").alias("_src"),
    )
    differs = ~F.struct(*[F.col(f"_w.{c}") for c in compared]).eqNullSafe(F.col("_o"))
    new = F.col("_stored") == 0
    won = won.select(
        *EVENT_KEY, *[F.col(f"_w.`{c}`").alias(c) for c in rest], "_stored", new.alias("_new"), ((F.col("_src") == 1) & (new | differs)).alias("_changed")
    )
    if stored is not None:
        broken = both.where(~valid).drop("_src").withColumns({"_stored": F.lit(1).cast("long"), "_new": F.lit(False), "_changed": F.lit(False)})
        won = won.unionByName(broken)
    return won.withColumn("day", F.date_format("snapshot_at", DATE))


def create(spark: SparkSession, folder: str, history: DataFrame) -> Manifest:
    """A new store from a whole history, rows with broken keys and repeated keys included, as they are."""
    store = DayStore(spark, folder)
    if store.manifest() is not None:
        raise RuntimeError(f"{folder} already holds a store")
    rows = history.withColumn("day", F.date_format("snapshot_at", DATE))
    rows.write.mode("overwrite").partitionBy("day").parquet(f"{store.folder}/days/v=1")
    schema = history.schema.jsonValue()
    kinds = StructType([*history.schema.fields, StructField("day", StringType())])
    written = spark.read.schema(kinds).parquet(f"{store.folder}/days/v=1")
    per_day = written.groupBy(F.coalesce("day", F.lit(UNDATED)).alias("day")).agg(F.count("*").alias("rows"), F.max("load_seq").alias("load")).collect()
    held = {r.day: {"v": 1, "rows": r.rows} for r in per_day}
    manifest = Manifest(1, held, None, schema, max((r.load or 0 for r in per_day), default=0))
    store.commit(manifest)
    return manifest
