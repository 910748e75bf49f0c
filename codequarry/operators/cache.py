"""The explanations table: keys, lookups, latest-by-key, deletions, outstanding work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def make_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(part.cast("string"), F.lit("")) for part in parts]), 256)


def request_key(
    kind: Column, version: Column, model: Column, thinking: Column, path: Column, mode: Column, signature: Column,
    messages: Column,
) -> Column:
    """Key over everything a generated text depends on; `messages` is their canonical JSON."""
    known_mode = F.when(mode == "detailed", mode).otherwise(F.lit("simple"))
    mode_part = F.when(kind == "segment", known_mode).otherwise(mode)
    return make_key(kind, version, model, thinking, F.replace(path, F.lit("\\"), F.lit("/")), mode_part, signature, messages)


def put(entries: DataFrame) -> DataFrame:
    """Entries(key, file_path, kind, content, model, created_at): blanks are dropped, the newest wins."""
    filled = entries.filter(F.trim(F.coalesce("content", F.lit(""))) != "")
    payload = [c for c in entries.columns if c != "key"]
    return filled.groupBy("key").agg(
        F.max_by(F.struct(*payload), F.struct("created_at", "content")).alias("_row")
    ).select("key", "_row.*")


def get_many(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(cache.select("key", "content"), "key")


def get_newest(cache: DataFrame, candidates: DataFrame, item: str) -> DataFrame:
    """Of an item's alternative keys, the entry generated last."""
    found = candidates.join(cache.select("key", "content", "created_at"), "key")
    return found.groupBy(item).agg(F.max_by(F.struct("key", "content"), F.struct("created_at", "key")).alias("_r")).select(
        item, "_r.*"
    )


def delete_keys(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("key"), "key", "left_anti")


def delete_files(cache: DataFrame, paths: DataFrame) -> DataFrame:
    return cache.join(paths.select("file_path"), "file_path", "left_anti")


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"))


def work_list(items: DataFrame, cache: DataFrame, forced: DataFrame, item: str) -> DataFrame:
    """Items whose key is not cached, and forced items whether cached or not."""
    again = items.join(forced.select(item).distinct(), item, "left_semi")
    missing = items.join(forced.select(item), item, "left_anti").join(cache.select("key").distinct(), "key", "left_anti")
    return again.unionByName(missing)


def complete_jobs_only(entries: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Entries of jobs that reached `complete`; others leave nothing behind."""
    done = envelopes.filter(F.col("type") == "complete").select("job_id").distinct()
    return entries.join(done, "job_id", "left_semi")
