"""Session builder and shared-storage helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import warnings
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "shelfweek", **conf) -> SparkSession:
    """A session with AQE (coalescing, skew-join splitting) and ANSI arithmetic on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    partitions = os.environ.get("SHELFWEEK_SHUFFLE_PARTITIONS")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", partitions)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master (tests) gets a temporary folder where the session names none; elsewhere that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if path:
        if current is None:
            spark.sparkContext.setCheckpointDir(path)
        return path
    if current is None and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if current is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shelfweek-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; cuts the lineage of iterative jobs."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few_rows_a_batch(spark: SparkSession, rows: int) -> None:
    """Let an Arrow batch hold at most ``rows`` rows: a row that packs a whole series is large, beside the heap and in Python."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(conf))
    if now <= 0 or now > rows:
        spark.conf.set(conf, str(rows))


def _stage_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/shelfweek_stages/{spark.sparkContext.applicationId}"


#: Spark's setting to remove the shuffle files of a query when it ends; a running session takes it.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries that start and end inside leave no shuffle files behind, on any executor.

    Without it they stay until the driver happens to collect garbage, beside the stage they were written for.
    """
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_END) if before is None else spark.conf.set(SHUFFLES_END, before)


#: Stages are written once and count as disk; zstd files are about a quarter smaller than Spark's default, snappy.
STAGE_CODEC = "zstd"
_TABLES: dict[str, list[str]] = {}
_cleared = 0


def stage_generation() -> int:
    """How often stages were cleared; whoever keeps frames built on stages keeps them for one generation only."""
    return _cleared


def materialise(df: DataFrame, label: str, bucket_by: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write a stage once as Parquet in the shared folder and read it back.

    Losing an executor then costs a re-read, not the whole lineage, and the size of a small stage is
    known from its files, so that Spark broadcasts it only when it really is small. The shuffle files it took are removed
    as soon as it is written. With ``bucket_by``
    the table is bucketed on that key, one file per bucket (``buckets``, or as many as shuffle partitions), so that
    later windows and aggregates on the key start without a shuffle.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex[:12]}"
    path = f"{_stage_root(spark)}/{name}"
    with shuffles_end(spark):
        if bucket_by is None:
            df.write.mode("overwrite").parquet(path, compression=STAGE_CODEC)
            return spark.read.schema(df.schema).parquet(path)
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spread = df.repartition(buckets, bucket_by)
        try:
            (
                spread.write.mode("overwrite")
                .bucketBy(buckets, bucket_by)
                .sortBy(bucket_by)
                .option("path", path)
                .option("compression", STAGE_CODEC)
                .saveAsTable(name)
            )
        except AnalysisException as refused:  # a catalog without bucketed tables
            warnings.warn(f"stage {label} is not bucketed: {refused}", stacklevel=2)
            spread.write.mode("overwrite").parquet(path, compression=STAGE_CODEC)
            return spark.read.schema(df.schema).parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(name)
    return spark.table(name)


def clear_stages(spark: SparkSession) -> None:
    """Drop the stages this application wrote; frames built on them can no longer be run."""
    global _cleared
    _cleared += 1
    for name in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(_stage_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
