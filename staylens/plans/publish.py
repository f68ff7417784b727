"""SNK1-SNK4: publishing the rebuild's tables.

Every publish writes a new version folder ``v=<n>`` and, only when all its
tables are written (and, for a merge, the audit passed), an empty
``_PUBLISHED`` marker.  Readers take the newest marked version, so a failed
run leaves the previous state in place without any copy-back (the
original's rollback) and a half-written version is never read.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from staylens.sources.files import _fs, exists

MARKER = "_PUBLISHED"

# The extract files and the action each one lists.
EXTRACT_ACTIONS = {
    "agoda_mapping": "Map Hotel to Agoda",
    "ctrip_mapping": "Expand to Ctrip",
    "room_type_mapping": "Complete Room-Type Mapping",
}


def _versions(spark: SparkSession, out_dir: str) -> list[tuple[int, bool]]:
    fs, p = _fs(spark, out_dir)
    if not fs.exists(p):
        return []
    out = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith("v="):
            try:
                n = int(name[2:])
            except ValueError:
                continue
            out.append((n, exists(spark, f"{out_dir.rstrip('/')}/{name}/{MARKER}")))
    return sorted(out)


def current_version(spark: SparkSession, out_dir: str) -> str | None:
    marked = [n for n, ok in _versions(spark, out_dir) if ok]
    return f"v={marked[-1]}" if marked else None


def new_version(spark: SparkSession, out_dir: str) -> str:
    versions = _versions(spark, out_dir)
    return f"v={(versions[-1][0] + 1) if versions else 1}"


def mark_published(spark: SparkSession, version_dir: str) -> None:
    fs, p = _fs(spark, f"{version_dir.rstrip('/')}/{MARKER}")
    fs.create(p, True).close()


def extracts(engine: DataFrame) -> dict[str, DataFrame]:
    """SNK2: top 20 by commercial rank and one list per mapping action."""
    out = {"top20": engine.where(F.col("`Commercial Rank`") <= 20)}
    for name, action in EXTRACT_ACTIONS.items():
        out[name] = engine.where(F.col("Action") == action)
    return out


def publish_outputs(
    spark: SparkSession, tables: dict[str, DataFrame], out_dir: str, mark: bool = True
) -> str:
    """SNK1 + SNK2: write every table into a new version; extracts come from the written engine."""
    version = new_version(spark, out_dir)
    base = f"{out_dir.rstrip('/')}/{version}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    if "engine" in tables:
        # filters over the written engine, not four recomputations of it
        for name, df in extracts(spark.read.parquet(f"{base}/engine")).items():
            df.write.mode("overwrite").parquet(f"{base}/{name}")
    if mark:
        mark_published(spark, base)
    return base


def save_snapshot(engine: DataFrame, snapshots_dir: str, day: _dt.date | None = None) -> None:
    """SNK3: a dated copy of the engine; rewriting a day replaces only that day's partition."""
    day = day or _dt.date.today()
    (
        engine.withColumn("snapshot_date", F.lit(day))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date")
        .parquet(snapshots_dir)
    )
