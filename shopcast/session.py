"""Spark session defaults for the analytics jobs.

On a cluster the session is created by the platform; these helpers only fill in
settings that are missing, never override ones the cluster already set.
"""

from __future__ import annotations

import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on: ANSI-safe arithmetic is written with try_divide,
# timestamps are wall-clock (TIMESTAMP_NTZ) and compared in UTC, AQE re-plans
# joins and coalesces / splits shuffle partitions at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Files of a checkpoint go when the driver no longer refers to it.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Whether the files of a query's shuffles are removed when it ends.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    builder = SparkSession.builder.appName("shopcast")
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("SHOPCAST_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint directory of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that one is
    used as is. Only a local session (tests, benches) without that setting gets a
    fresh scratch folder; on a cluster a folder of the driver is of no use to
    executors, so a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="shopcast-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for written tables, below the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table is at ``path``; any other trouble in reading it is an error."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> str:
    """Write ``tables`` as one new version of what is at ``path`` and return its folder.

    Every version has a folder of its own, so readers of an older one are not disturbed. A row of the manifest, written last,
    makes the version known: a job that ends before that leaves the version before in place, never a mixture. Folders of
    older versions stay until somebody removes them.
    """
    version = f"{path}/versions/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{version}/{name}")
    row = spark.createDataFrame([(time.time_ns(), version.rsplit("/", 1)[1])], "published_at long, version string")
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def published(spark: SparkSession, path: str) -> str | None:
    """Folder of the version that was published last at ``path``, or None."""
    if not exists(spark, f"{path}/manifest"):
        return None
    last = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("published_at"), F.desc("version")).first()
    return f"{path}/versions/{last['version']}" if last else None


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context, so that functions run there wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_shopcast_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="shopcast-py-")) / "shopcast.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    sc._shopcast_shipped = True


def prepare(spark: SparkSession) -> None:
    """What every registered query needs of a session: a checkpoint directory, and this package on the workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint directory and return the re-read frame.

    Used where one intermediate result feeds several later joins: it is
    computed once, survives executor loss (unlike a cached or
    locally-checkpointed copy) and the downstream plans stay short. What was shuffled to make it
    is not needed any more, and its files are removed, so that the shuffles of a job's steps don't add up on disk.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(REMOVE_SHUFFLES)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)


def compact(*frames: DataFrame, by: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """As :func:`materialize`, for many narrow rows that are read in full: they are written compressed, a batch of rows to a value.

    Several frames of one schema are written one after the other, and read as their union.
    """
    schema = frames[0].schema

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(b)
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["rows"])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in b.column("rows"):
                yield from pa.ipc.open_stream(rows.as_buffer())

    return reduce(DataFrame.union, [by(df.mapInArrow(write, "rows binary")) for df in frames]).mapInArrow(read, schema)
