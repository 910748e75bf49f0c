"""Conversations and job streams as batch jobs: gates, sessions, anchors, checkpoints, reports.

Each has a keyed-state twin in `codequarry.streaming`; both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.operators.evidence import joined
from codequarry.operators.topk import top_k
from codequarry.options import DEFAULTS

TERMINAL = ("complete", "done", "cancelled", "error")


def envelope_gate(envelopes: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """envelopes(request_id, arrived, job_id, seq, type, event_id) to those a client accepts.

    A request belongs to the job of its first envelope; later ones must have a growing seq, and
    nothing follows a terminal one. "Largest seq so far" is a prefix maximum, taken in two levels:
    within time slices, and over the slices' own maxima. A request with very many envelopes is
    thereby split over many tasks.
    """
    owner = envelopes.groupBy("request_id").agg(F.min_by("job_id", F.struct("arrived", "seq", "event_id")).alias("_job"))
    own = envelopes.filter("seq >= 0").join(owner, "request_id").filter(F.col("job_id") == F.col("_job")).drop("_job")
    sliced = own.withColumn("_slice", F.floor(F.unix_seconds("arrived") / slice_seconds))
    peaks = sliced.groupBy("request_id", "_slice").agg(F.max("seq").alias("_peak"))
    over = Window.partitionBy("request_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = peaks.select("request_id", "_slice", F.max("_peak").over(over).alias("_carry"))
    inside = Window.partitionBy("request_id", "_slice").orderBy("arrived", "seq", "event_id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    rated = sliced.join(carried, ["request_id", "_slice"]).withColumn(
        "_last", F.greatest(F.col("_carry"), F.max("seq").over(inside), F.lit(-1))
    )
    growing = rated.filter(F.col("seq") > F.col("_last")).drop("_slice", "_carry", "_last")
    ends = growing.filter(F.col("type").isin(*TERMINAL)).groupBy("request_id").agg(
        F.min(F.struct("arrived", "seq", "event_id")).alias("_end")
    )
    kept = growing.join(ends, "request_id", "left").filter(
        F.col("_end").isNull() | (F.struct("arrived", "seq", "event_id") <= F.col("_end"))
    )
    return kept.drop("_end")


def job_phase(accepted: DataFrame) -> DataFrame:
    """Final phase, last seq and last status message of every request."""
    newest = F.struct("seq")
    phase = F.max_by("type", newest)
    return accepted.groupBy("request_id").agg(
        F.max("seq").alias("last_seq"), F.count("*").alias("accepted"),
        F.when(phase.isin("complete", "done"), "complete").when(phase.isin("cancelled", "error"), phase)
        .otherwise("running").alias("phase"),
    )


def scope_of(target: Column, scope_id: Column, payload_scope: Column) -> Column:
    """Where a delta belongs: its target, else the envelope's scope, else the payload's."""
    chosen = F.coalesce(
        F.when(target != "", target), F.when(scope_id != "", scope_id), payload_scope, F.lit("")
    )
    return F.regexp_replace(chosen, "^segment:", "")


def assemble_deltas(deltas: DataFrame) -> DataFrame:
    """deltas(request_id, scope, seq, text) to one text per scope."""
    return deltas.filter(F.col("text") != "").groupBy("request_id", "scope").agg(
        joined(F.col("text"), F.col("seq"), "").alias("text")
    )


def sessions(events: DataFrame, ttl_minutes: int = DEFAULTS.session_ttl_minutes) -> DataFrame:
    """events(user_id, ts) to activity sessions with gaps of at most the TTL.

    Events are first reduced to one row per user and minute. A minute is shorter than any TTL, so
    that changes nothing, and it bounds the rows of a very busy user by the minutes there are.
    """
    minutes = events.groupBy("user_id", F.date_trunc("minute", "ts").alias("_minute")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")
    )
    order = Window.partitionBy("user_id").orderBy("_minute")
    gap = F.unix_micros("first") - F.unix_micros(F.lag("last").over(order))
    fresh = F.when(gap.isNull() | (gap > ttl_minutes * 60_000_000), 1).otherwise(0)
    numbered = minutes.withColumn("_fresh", fresh).withColumn("session_no", F.sum("_fresh").over(order))
    return numbered.groupBy("user_id", "session_no").agg(
        F.min("first").alias("started"), F.max("last").alias("updated"), F.sum("n").alias("events")
    )


def live_sessions(all_sessions: DataFrame, capacity: int | None = DEFAULTS.sessions, keys: list[str] | None = None) -> DataFrame:
    """The most recently used sessions of every key (a user, a project); all of them without a capacity."""
    if capacity is None:
        return all_sessions
    order = [F.col("updated").desc(), F.col("session_no").desc()]
    return top_k(all_sessions, keys or ["user_id"], order, capacity, "_n").drop("_n")


def merge_anchors(anchors: DataFrame, keep: int = DEFAULTS.anchors) -> DataFrame:
    """anchors(conversation_id, ord, path, start_line, end_line, source_hash, symbol): newest per key, last `keep`."""
    fine = anchors.withColumn("path", F.replace("path", F.lit("\\"), F.lit("/"))).filter(
        (F.coalesce("path", F.lit("")) != "") & (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line"))
    )
    key = ["conversation_id", "path", "start_line", "end_line", "symbol"]
    newest = fine.groupBy(*key).agg(F.max_by("source_hash", "ord").alias("source_hash"), F.max("ord").alias("ord"))
    return top_k(newest, ["conversation_id"], [F.col("ord").desc()], keep, "_n").drop("_n")


def redact(events: DataFrame) -> DataFrame:
    """Tool results keep their locators, never their text."""
    hidden = F.col("kind") == "tool_result"
    return events.withColumn("content", F.when(~hidden, F.col("content"))).withColumn(
        "items", F.when(~hidden, F.col("items"))
    )


def last_messages(messages: DataFrame, keep: int = DEFAULTS.messages) -> DataFrame:
    spoken = messages.filter(F.col("role").isin("user", "assistant") & (F.coalesce("content", F.lit("")) != ""))
    return top_k(spoken, ["conversation_id"], [F.col("turn").desc()], keep, "age")


def checkpoint_summaries(messages: DataFrame, keep: int = DEFAULTS.messages, each: int = 160, total: int = 2048) -> DataFrame:
    """One summary per conversation of everything older than its last `keep` messages.

    The oldest kept turn comes from a bounded top-k, and only so many of the older messages as can
    reach into the first `total` characters are joined.
    """
    spoken = messages.filter(F.col("role").isin("user", "assistant") & (F.coalesce("content", F.lit("")) != ""))
    horizon = last_messages(messages, keep).groupBy("conversation_id").agg(F.min("turn").alias("_from"))
    older = spoken.join(horizon, "conversation_id").filter(F.col("turn") < F.col("_from"))
    shortest = len("user: x；")
    needed = top_k(older, ["conversation_id"], [F.col("turn")], total // shortest + 1, "_n")
    entry = F.concat("role", F.lit(": "), F.substring("content", 1, each))
    return needed.groupBy("conversation_id").agg(
        F.substring(joined(entry, F.col("turn"), "；"), 1, total).alias("summary")
    )


def merge_reports(records: DataFrame, keep: int | None = DEFAULTS.reports) -> DataFrame:
    """records(project_id, path, ord, source_hash, segment, text) to the current report rows.

    Segments add up while the hash stays; a change of hash starts over. Of a project's reports the
    last `keep` remain, all of them without a number.
    """
    key = ["project_id", "path"]
    current = records.groupBy(*key).agg(
        F.max_by("source_hash", "ord").alias("_hash"), F.max("ord").alias("last_ord")
    )
    known = records.join(current, key)
    breaks = known.filter(F.col("source_hash") != F.col("_hash")).groupBy(*key).agg(F.max("ord").alias("_break"))
    live = known.join(breaks, key, "left").filter(
        (F.col("source_hash") == F.col("_hash")) & (F.col("ord") > F.coalesce("_break", F.lit(-1)))
    )
    merged = live.groupBy(*key, "source_hash", "last_ord", "segment").agg(F.max_by("text", "ord").alias("text"))
    if keep is None:
        return merged
    recent = top_k(current, ["project_id"], [F.col("last_ord").desc(), F.col("path")], keep, "_n").select(*key)
    return merged.join(recent, key, "left_semi")
