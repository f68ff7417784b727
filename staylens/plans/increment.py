"""Entry 2 / SNK4: merge a daily export, rebuild, audit, then publish.

The merge is staged in the store by affected day (``plans/daystore.py``).  If
it changes nothing, nothing is published.  Otherwise the rebuild and its audit
run on the staged days; only if every blocking check passed is the manifest
committed, which names the new days, the former ones as ``previous`` and the
new outputs at once.  A crash or a failed audit before that leaves the store
and its outputs as they were.

``_PUBLISHED`` markers of the output folder follow the manifest: one that a
crash kept from being written is written by the next merge.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from staylens.operators import audit as AU, facts
from staylens.plans import publish
from staylens.plans.daystore import DayStore
from staylens.plans.rebuild import Rebuild, Sources
from staylens.sources.files import exists


class AuditFailed(RuntimeError):
    pass


def blocking() -> F.Column:
    """Audit rows that stop a publish: wrong values, phantom keys, lost hotel or history keys.

    A destination-date seen only on rows that are not the newest of their
    hotel has no funnel row by construction (the funnel is hotel-based),
    and a baseline with fewer batches than the current window is a property
    of the data; both are reported by the audit but do not block.
    """
    tables = F.col("check") != "window_batches"
    lost = (F.col("missing_in_actual") > 0) & (F.col("check") != "destination_searches")
    return tables & ((F.col("value_different") > 0) | (F.col("missing_in_expected") > 0) | lost)


def read_store(spark: SparkSession, store_dir: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The committed latest and previous demand."""
    store = DayStore(spark, store_dir)
    manifest = store.manifest()
    return store.read(manifest, "latest"), store.read(manifest, "previous")


def read_output(spark: SparkSession, store_dir: str, name: str) -> DataFrame:
    """A table of the outputs that belong to the committed store."""
    manifest = DayStore(spark, store_dir).manifest()
    if manifest is None or manifest.outputs is None:
        raise FileNotFoundError(f"{store_dir} has no published outputs")
    return spark.read.parquet(f"{manifest.outputs}/{name}")


def _follow(spark: SparkSession, outputs: str | None) -> None:
    if outputs is not None and not exists(spark, f"{outputs}/{publish.MARKER}"):
        publish.mark_published(spark, outputs)


def merge_publish(
    spark: SparkSession,
    store_dir: str,
    upload: DataFrame,
    dims: Sources,
    out_dir: str,
    gap_seconds: int = 300,
) -> dict:
    """Merge ``upload`` into the stored history and publish a rebuilt, audited version."""
    store = DayStore(spark, store_dir)
    before = store.manifest()
    _follow(spark, before.outputs if before else None)
    staged = store.stage(upload)
    if not staged.stats["data_changed"]:
        return {**staged.stats, "published": None}

    latest = store.read(staged.manifest, "latest")
    previous = store.read(before, "latest")
    r = Rebuild(replace(dims, latest=latest, previous=previous), gap_seconds)
    out_base = publish.publish_outputs(spark, r.outputs(), out_dir, mark=False)
    published_hist = (
        spark.read.parquet(f"{out_base}/historical_hotel_date"),
        spark.read.parquet(f"{out_base}/historical_destination_date"),
    )
    checks = AU.audit(
        r.windows.current,
        r.windows.baseline,
        spark.read.parquet(f"{out_base}/hotel_date_funnel"),
        facts.stored_history(r.latest, r.previous, gap_seconds),
        published_hist,
    )
    failed = [row["check"] for row in checks.where(blocking()).collect()]  # at most five rows
    if failed:
        raise AuditFailed(f"audit failed ({', '.join(failed)}); commit {staged.manifest.number} left out")
    store.commit(replace(staged.manifest, outputs=out_base))
    _follow(spark, out_base)
    return {**staged.stats, "published": out_base}
