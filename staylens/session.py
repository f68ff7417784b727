"""Spark session defaults and lineage helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults for every session we build ourselves.  On a cluster the
# submitter's settings win: ``getOrCreate`` returns the existing session and
# we only add what is missing.
SESSION_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "staylens",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    if not (master or "").startswith("local"):
        # on a shared cluster, coalesce small shuffles to the advisory size
        # instead of keeping one partition per core; a single node keeps
        # Spark's default so CPU-heavy stages stay parallel
        builder = builder.config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared lineage-cut folder named by ``spark.checkpoint.dir``.

    On a cluster the submitter must set it to a shared file system.  Only a
    local-mode session (tests, bench) without the setting gets a private
    temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running staylens jobs on a cluster"
        )
    local = tempfile.mkdtemp(prefix="staylens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, name: str = "cut", partition_by: str | None = None) -> DataFrame:
    """Materialise ``df`` as Parquet under the shared checkpoint folder and read it back.

    One job (a reliable RDD checkpoint of an uncached plan computes it
    twice), survives executor loss (unlike a local checkpoint), and gives
    the optimizer the real size of the result for later join planning.  The
    shuffle files of the job are deleted when it is done: the written table
    stands for them, so a chain of cuts holds the files of one job at a time.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/staylens-tables/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of lineage cuts that nothing reads any more; other tables are left alone.

    Only for cuts whose readers have all been written themselves: a plan that
    still reads one could not be run again after an executor is lost.
    """
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles() if "/staylens-tables/" in f}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
