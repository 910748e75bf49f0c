"""Running streams to completion into files, and applying change feeds to a store."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.operators import refresh
from codequarry.session import cut, shared_dir
from codequarry.sources.store import Derive, FactStore, apply_actions

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame) -> DataFrame:
    """Process everything available now, checkpointed in the shared folder, and read the result."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    place = f"{shared_dir(spark).rstrip('/')}/codequarry-stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def table_stream(spark: SparkSession, directory: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """One of the driver tables, a file or a folder of files, as a stream of files, so many of them in a micro-batch."""
    place = f"{directory.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(place).schema
    # A stream takes a file only by a pattern; this one matches nothing but the table.
    frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{place[:-1]}[t]")
    for field in schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            frame = frame.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return frame


def refresh_from_feed(feed: DataFrame, store: FactStore, hash_of: Column, checkpoint: str, derive: dict[str, Derive] | None = None):
    """Apply a stream of changed files batch by batch. A batch redone after a failure changes nothing.

    A feed only brings files: one that is now too large or binary leaves the store.
    """

    def one_batch(batch: DataFrame, _number: int) -> None:
        latest = cut(batch.groupBy(*refresh.KEYS).agg(
            F.max_by(F.struct(*[c for c in batch.columns if c not in refresh.KEYS]), "mtime_ns").alias("r")
        ).select(*refresh.KEYS, "r.*"))
        known = store.read("files").join(latest.select(*refresh.KEYS), refresh.KEYS, "left_semi")
        actions = refresh.plan_refresh(latest, known, hash_of).select(*refresh.KEYS, "size", "mtime_ns", "source_hash", "action")
        apply_actions(store, latest, cut(actions), derive or {})

    return feed.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
