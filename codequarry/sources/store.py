"""Versioned Parquet tables of derived facts.

Tables live under `base/v<version>/<table>`; another version is another folder, built aside, never
migrated, and taken up by readers when the pointer table names it. Rows are partitioned by project and
path bucket, so a refresh rewrites only the buckets it touched and a giant project is still many
partitions. Within a partition a table can be sorted, so that readers skip what they don't ask for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import refresh
from codequarry.options import DEFAULTS
from codequarry.session import cut

PARTITIONS = ["project_id", "path_bucket"]
#: From files with their text to the rows of one table; every row carries project_id and path of its file.
Derive = Callable[[DataFrame], DataFrame]


class FactStore:
    """buckets: parts of each project, to be set by its size; orders: columns that a table is sorted by."""

    def __init__(
        self, spark: SparkSession, base: str, version: int | str = DEFAULTS.schema_version, buckets: int = 16,
        orders: dict[str, list[str]] | None = None,
    ):
        self.spark, self.base, self.version, self.buckets, self.orders = spark, base.rstrip("/"), version, buckets, orders or {}

    @classmethod
    def current(cls, spark: SparkSession, base: str, buckets: int = 16, orders: dict[str, list[str]] | None = None) -> FactStore | None:
        """The store in the version that was published last; None before the first."""
        try:
            newest = spark.read.parquet(f"{base.rstrip('/')}/pointer").agg(F.max_by("version", "turn")).first()[0]
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        return cls(spark, base, newest, buckets, orders) if newest is not None else None

    def publish(self) -> None:
        """Make this version the one that readers open; its tables are complete by now. Older ones stay as they are."""
        known = self.current(self.spark, self.base)
        turn = 0 if known is None else self.spark.read.parquet(f"{self.base}/pointer").agg(F.max("turn")).first()[0] + 1
        row = self.spark.createDataFrame([(str(self.version), turn)], "version string, turn bigint")
        row.coalesce(1).write.mode("append").parquet(f"{self.base}/pointer")

    def location(self, table: str) -> str:
        return f"{self.base}/v{self.version}/{table}"

    def _bucket(self) -> Column:
        return F.pmod(F.crc32("path"), F.lit(self.buckets)).cast("int")

    @property
    def parts(self) -> int:
        """Tasks that lay a table out: four a bucket, as the projects share each bucket number's input."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * self.buckets)

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows of files at the task that writes their bucket; what is derived from them there needs no other shuffle."""
        return rows.withColumn("path_bucket", self._bucket()).repartition(self.parts, *PARTITIONS).drop("path_bucket")

    def _save(self, table: str, rows: DataFrame, mode: str, placed: bool = False) -> None:
        rows = (rows if placed else self.placed(rows)).withColumn("path_bucket", self._bucket())
        laid_out = rows.sortWithinPartitions(*PARTITIONS, *self.orders.get(table, []))
        laid_out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(self.location(table))

    def create(self, table: str, rows: DataFrame, placed: bool = False) -> None:
        """placed: the rows were derived, row by row, from what `placed` gave."""
        self._save(table, rows.withColumn("live", F.lit(True)), "errorifexists", placed)

    def _rows(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.location(table)).withColumn("project_id", F.col("project_id").cast("string"))

    def read(self, table: str) -> DataFrame:
        return self._rows(table).filter("live").drop("live", "path_bucket")

    def replace_files(self, table: str, new_rows: DataFrame, touched: DataFrame) -> None:
        """Replace everything stored for the touched (project_id, path) pairs by `new_rows`.

        Old rows of the touched buckets and the new ones go to a fresh table first, and only that is
        written over those partitions. A path left without rows keeps one dead row, so that every
        touched partition is rewritten even when its last file is gone.
        """
        stored = self._rows(table)
        keys = cut(touched.select("project_id", "path").distinct()).withColumn("path_bucket", self._bucket())
        kept = stored.join(keys.select(*PARTITIONS).distinct(), PARTITIONS, "left_semi").join(
            keys, [*PARTITIONS, "path"], "left_anti"
        ).drop("path_bucket")
        rows = new_rows.withColumn("live", F.lit(True)).select(*kept.columns)
        dead = keys.join(rows.select("project_id", "path"), ["project_id", "path"], "left_anti").select(
            *[
                F.col(f.name) if f.name in ("project_id", "path") else F.lit(False).alias("live") if f.name == "live"
                else F.lit(None).cast(f.dataType).alias(f.name)
                for f in kept.schema.fields
            ]
        )
        self._save(table, cut(kept.unionByName(rows).unionByName(dead)), "overwrite")

    def extend(self, table: str, rows: DataFrame, placed: bool = False) -> None:
        """Add rows to a table that belongs to no file, such as a vocabulary. placed: each task sorts the rows it has."""
        order = self.orders.get(table, [])
        if order:
            rows = (rows if placed else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
        rows.write.mode("append").parquet(self.location(table))

    def whole(self, table: str) -> DataFrame:
        """A table that belongs to no file."""
        return self.spark.read.parquet(self.location(table))


def build_facts(store: FactStore, files: DataFrame, derive: dict[str, Derive]) -> None:
    """The table of files and everything derived from it, then the pointer to them."""
    store.create("files", files)
    for table, rows_of in derive.items():
        store.create(table, rows_of(files))
    store.publish()


def apply_actions(store: FactStore, listing: DataFrame, actions: DataFrame, derive: dict[str, Derive]) -> None:
    """Replace the files the actions touch, and every derived row of theirs.

    Texts meet their keys only for paths that came or changed. A file that was merely touched keeps its
    derived rows. The table of files comes last: a refresh that was cut short finds the same work again.
    """
    came = actions.filter(F.col("action").isin("added", "updated", "confirmed")).select(*refresh.KEYS, "source_hash", "action")
    stored = store.read("files").columns
    new = cut(listing.drop("source_hash").join(came, refresh.KEYS).select(*stored, "action"))
    texts = new.filter("action <> 'confirmed'").select(*stored)
    touched = actions.filter(F.col("action").isin("added", "updated", "removed"))
    for table, rows_of in derive.items():
        store.replace_files(table, rows_of(texts), touched)
    store.replace_files("files", new.select(*stored), actions.filter("action NOT IN ('reused', 'skipped')"))


def refresh_facts(store: FactStore, listing: DataFrame, hash_of: Column, derive: dict[str, Derive] | None = None) -> DataFrame:
    """Bring a store up to a full listing; returns the action taken per path."""
    columns = [*refresh.KEYS, "size", "mtime_ns", "source_hash", "action"]
    actions = cut(refresh.plan_refresh(listing, store.read("files"), hash_of).select(*columns))
    apply_actions(store, listing, actions, derive or {})
    return actions
