"""Daily exports as a file stream: each new CSV in the landing folder is merged.

``readStream`` over the landing folder with the all-text export schema
(a stream needs a schema; ``enforceSchema=false`` makes a file whose
header disagrees fail instead of silently binding by position), then
``foreachBatch`` merges each file into the days it touches (F5, lenient).
``trigger(availableNow=True)`` processes what has landed and stops, so
the job can run on a schedule.

Rows that cannot be merged (an unreadable stamp or date, an unsupported
status) go to the store's quarantine with their reason and the stream goes on;
rows without a hotel are skipped and counted, as in a batch merge.

The commit of a file also names its epoch in the manifest, per stream, so the
rows and the log can't part.  An epoch at or below the one named there has been
merged: replaying it after a crash changes nothing, and neither does it write
a second quarantine.  The stream is known by the place of its checkpoint.  No
watermark: late or back-filled rows are accepted at any age, as in the
original, and touch the days they belong to.

There is no streaming session window here on purpose: a session window
without another grouping key is rejected by Structured Streaming, and the
observation batches are global, so batching runs in the rebuild.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from staylens.operators import clean
from staylens.plans.daystore import DayStore

EXPORT_SCHEMA = StructType([StructField(c, StringType(), True) for c in clean.REQUIRED_DEMAND_COLUMNS])


def merge_epoch(store_dir: str, stream: str) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function of the stream ``stream``."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        store = DayStore(batch.sparkSession, store_dir)
        manifest = store.manifest()
        if manifest is not None and epoch_id <= manifest.epochs.get(stream, -1):
            return
        typed = clean.type_demand(batch).withColumn("row_seq", F.monotonically_increasing_id())
        staged = store.stage(typed, strict=False, stream=stream, epoch=int(epoch_id))
        store.commit(staged.manifest)

    return run


def start_increment_stream(
    spark: SparkSession,
    landing_dir: str,
    store_dir: str,
    checkpoint_location: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Merge every export that lands in ``landing_dir`` into the store at ``store_dir``."""
    exports = (
        spark.readStream.format("csv")
        .option("header", True)
        .option("enforceSchema", False)
        .option("maxFilesPerTrigger", 1)  # one daily export per merge, in arrival order
        .schema(EXPORT_SCHEMA)
        .load(landing_dir)
    )
    writer = exports.writeStream.foreachBatch(merge_epoch(store_dir, checkpoint_location.rstrip("/"))).option(
        "checkpointLocation", checkpoint_location
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
