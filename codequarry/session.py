"""Session helpers: local builder for tests, adaptive settings, and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where that costs one more exchange further up the plan.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows go to Python in batches of bounded size, so very long texts don't add up.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Folders that a task writes side by side. With more of them the rest is sorted first, as all are without this.
_WRITERS, _FOLDERS = "spark.sql.maxConcurrentOutputFileWriters", "8"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName("codequarry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in _ADAPTIVE.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    return session


def tune(spark: SparkSession) -> SparkSession:
    """Apply the adaptive settings to a session somebody else built, and give its executors this package."""
    for key, value in _ADAPTIVE.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per Spark context: tasks import it by name."""
    context = spark.sparkContext
    if getattr(context, "_codequarry_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="spark-codequarry-"))
    # Spark serves the archive to every executor from here on.
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
    context._codequarry_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's, or in local mode a scratch one where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-codequarry-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back, so later stages start from files.

    Unlike a cached block, the result outlives a lost executor, and later filters and column
    choices are still pushed into the Parquet scan.
    """
    spark = df.sparkSession
    target = f"{shared_dir(spark).rstrip('/')}/codequarry-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    # Nothing reads again what was shuffled for a table that is written, so its files go at once.
    before = {_CLEANUP: spark.conf.get(_CLEANUP, "false"), _WRITERS: spark.conf.get(_WRITERS, "0")}
    spark.conf.set(_CLEANUP, "true")
    spark.conf.set(_WRITERS, _FOLDERS)
    try:
        writer.parquet(target)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(target)
