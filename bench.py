"""Benchmark the headline flows; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_GAP_SECONDS (default 60: at sf0.1 a 300 s gap leaves
best run is reported).

The flows follow the original's three entry points:

* the fact queries the planning probe timed (batch map, hotel x check-in,
  destination x check-in) and the stored-history facts, each from scratch;
* ``rebuild``: the whole batch rebuild (windows, history, summary, funnel,
  engine) written as versioned Parquet into a scratch folder;
* dashboard views computed from those published tables (as the page does);
* week comparisons from the raw demand, and the incremental merge.

Every query is forced with a ``noop`` write (or a real write for the
rebuild), so the time covers the full distributed work without moving
results to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from staylens.session import get_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    gap = int(os.environ.get("BENCH_GAP_SECONDS", "60"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    extra = {"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"}
    if os.environ.get("BENCH_EVENT_LOG"):
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]})
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus, app_name="staylens-bench", extra=extra)

    from pyspark.sql import functions as F

    from staylens.operators import batches, clean, facts, views, weeks
    from staylens.operators.merge import merge_incremental
    from staylens.plans import publish
    from staylens.plans.rebuild import Rebuild, driver_sources
    from staylens.session import cut_lineage
    from staylens.sources import driver_tables as T
    from staylens.sources.files import read_published

    out_dir = tempfile.mkdtemp(prefix="staylens-bench-out-")

    def latest():
        return clean.prepare_demand(T.demand_latest(spark, sf_dir))

    def previous():
        return clean.prepare_demand(T.demand_previous(spark, sf_dir))

    def published(name):
        return read_published(spark, out_dir, name)

    def detail():
        return views.home_detail(published("hotel_date_funnel"), published("engine"))

    def rebuild():
        publish.publish_outputs(spark, Rebuild(driver_sources(spark, sf_dir), gap).outputs(), out_dir)
        return None

    def checkin_week():
        full = facts.full_history_funnel(T.demand_latest(spark, sf_dir), gap)
        d = cut_lineage(weeks.checkin_detail(full, published("engine")), "checkin_detail")
        return weeks.checkin_week_hotels(d)

    def merge():
        hist = T.demand_previous(spark, sf_dir)
        upload = T.demand_latest(spark, sf_dir).where(
            (F.col("snapshot_at") >= F.lit(T.PREVIOUS_CUTOFF).cast("timestamp_ntz")) | (F.col("load_seq") == 1)
        )
        return merge_incremental(hist, upload).merged

    queries = {
        "observation_batches": lambda: batches.batch_map(latest(), gap),
        "hotel_checkin": lambda: facts.hotel_checkin(latest(), gap),
        "destination_checkin": lambda: facts.destination_checkin(latest(), gap),
        "historical_hotel_date": lambda: facts.stored_history(latest(), previous(), gap)[0],
        "rebuild": rebuild,
        "daily_market": lambda: views.daily_market(detail()),
        "daily_kpis": lambda: (lambda d: views.daily_kpis(d, published("historical_destination_date"),
                                                          views.daily_market(d)))(detail()),
        "date_worklist": lambda: views.date_worklist(published("historical_hotel_date"), detail()),
        "snapshot_week": lambda: weeks.snapshot_week(T.demand_latest(spark, sf_dir), gap),
        "checkin_week_hotels": checkin_week,
        "merge_incremental": merge,
    }

    # warm-up: JVM, code generation and the Parquet footers of every table
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    facts.hotel_checkin(latest(), gap).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name, build in queries.items():
        best = None
        for _ in range(repeat):
            spark.catalog.clearCache()
            spark.sparkContext.setJobDescription(name)
            t0 = time.perf_counter()
            df = build()
            if df is not None:
                df.write.format("noop").mode("overwrite").save()
            elapsed = time.perf_counter() - t0
            best = elapsed if best is None else min(best, elapsed)
        times[name] = round(best, 3)

    sf = sf_dir.rsplit("sf", 1)[-1] if "sf" in os.path.basename(sf_dir) else sf_dir
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "cpus": cpus,
                "gap_seconds": gap,
                "repeat": repeat,
            }
        )
    )


if __name__ == "__main__":
    main()
