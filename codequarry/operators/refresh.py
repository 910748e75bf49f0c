"""Incremental maintenance: what changed since the stored snapshot, and what that means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.options import DEFAULTS, Options

KEYS = ["project_id", "path"]


def force_rehash(stored: DataFrame, paths: DataFrame) -> DataFrame:
    """Mark stored rows of the given (project_id, path) list so that they are hashed again."""
    marked = paths.select(*KEYS).distinct().withColumn("_forced", F.lit(True))
    return stored.join(marked, KEYS, "left").withColumn(
        "mtime_ns", F.when(F.col("_forced"), F.lit(-1).cast("long")).otherwise(F.col("mtime_ns"))
    ).drop("_forced")


# Columns that carry text; they stay out of the join of listing and store.
TEXT_COLUMNS = ("content", "lines")


def plan_refresh(listing: DataFrame, stored: DataFrame, hash_of: Column, options: Options = DEFAULTS) -> DataFrame:
    """Full outer join of the current listing and the stored files to one action per path.

    listing needs size, mtime_ns and whatever `hash_of` reads (null meaning undecodable); stored
    needs size, mtime_ns and source_hash. Same size and time is reused without hashing. Only keys,
    sizes and times meet in the outer join; texts are read and hashed for the paths it leaves open,
    and aren't part of the result.
    """
    now = listing.drop(*TEXT_COLUMNS).withColumn("_here", F.lit(True))
    if "source_hash" in now.columns:
        now = now.drop("source_hash")
    old = stored.select(
        *KEYS, F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"),
        F.col("source_hash").alias("_hash"), F.lit(True).alias("_stored"),
    )
    same = F.coalesce((F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime")), F.lit(False))
    fits = F.coalesce(F.col("size") <= options.max_file_bytes, F.lit(False))
    both = now.join(old, KEYS, "full_outer").withColumn("_same", same).withColumn("_open", F.col("_here").isNotNull() & fits & ~same)
    hashed = listing.join(both.filter("_open").select(*KEYS), KEYS, "left_semi").select(*KEYS, hash_of.alias("new_hash"))
    known = both.join(hashed, KEYS, "left")
    kept = F.col("_stored").isNotNull()
    action = (
        F.when(F.col("_here").isNull(), F.lit("removed"))
        .when(F.col("size") > options.max_file_bytes, F.when(kept, F.lit("removed")).otherwise(F.lit("skipped")))
        .when(F.col("_same"), F.lit("reused"))
        .when(F.col("new_hash").isNull(), F.when(kept, F.lit("removed")).otherwise(F.lit("skipped")))
        .when(F.col("new_hash") == F.col("_hash"), F.lit("confirmed"))
        .when(kept, F.lit("updated"))
        .otherwise(F.lit("added"))
    )
    return known.withColumn("action", action).withColumn(
        "source_hash", F.coalesce("new_hash", "_hash")
    ).drop("_here", "_size", "_mtime", "_hash", "_stored", "_same", "_open", "new_hash")


def refresh_summary(actions: DataFrame) -> DataFrame:
    """Counters per project, and whether its generation moves on."""
    counted = actions.groupBy("project_id").agg(
        *[
            F.count_if(F.col("action") == name).alias(f"{name}_files")
            for name in ("added", "updated", "reused", "confirmed", "removed", "skipped")
        ]
    )
    changed = F.col("added_files") + F.col("updated_files") + F.col("removed_files") > 0
    return counted.withColumn("generation_step", changed.cast("int"))


def with_parse_errors(summary: DataFrame, errors: DataFrame) -> DataFrame:
    """The counters with `parse_error_files`, from the stored table errors(project_id, path, parse_error).

    The messages stay rows of that table: a project may have any number of them.
    """
    counted = errors.filter("parse_error <> ''").groupBy("project_id").agg(F.countDistinct("path").alias("parse_error_files"))
    return summary.join(counted, "project_id", "left").na.fill(0, ["parse_error_files"])


def removed_files(stored: DataFrame, seen: DataFrame) -> DataFrame:
    return stored.join(seen.select(*KEYS), KEYS, "left_anti")
