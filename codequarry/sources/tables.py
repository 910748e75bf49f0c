"""The driver tables as DataFrames, with timestamps read as UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    frame = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
    for field in frame.schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            frame = frame.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return frame


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Use every core on an input with fewer splits than the cluster has cores.

    A large table already has more splits than that and passes through without a shuffle. Files are
    counted from the listing, so nothing is planned for it.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores, key) if len(frame.inputFiles()) < cores else frame
