"""Registered queries: the keyed stream processors against the same answers as their batch twins, and the store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codequarry.operators import sessions as ss
from codequarry.plans import session_queries as sq
from codequarry.plans.corpus_queries import snapshot_pair
from codequarry.plans.registry import entries, query
from codequarry.session import shared_dir
from codequarry.sources.store import FactStore, build_facts, refresh_facts
from codequarry.streaming import runs, state


# More minutes than any table spans.
ANY_LATENESS = 100 * 366 * 24 * 60
SQL_METRICS = entries()["generation_metrics"].sql


@query("stream_envelope_gate", f"WITH {sq.SQL_ENVELOPES} SELECT event_id, request_id, job_id, seq, type FROM accepted")
def stream_envelope_gate(spark, sf):
    # A stream drained to its end keeps its keys; expiry by processing time is for streams that go on.
    gated = state.gate_stream(sq.shape_envelopes(runs.table_stream(spark, sf, "events")), ttl_minutes=None)
    return runs.drain(gated).select("event_id", "request_id", "job_id", "seq", "type")


@query("stream_sessions", f"""WITH {sq.SQL_SESSIONS} SELECT user_id, session_no, epoch_us(started) AS started_us, epoch_us(updated) AS updated_us, events FROM sess""")
def stream_sessions(spark, sf):
    # The table's files come in any order, so nothing in it counts as late.
    events = runs.table_stream(spark, sf, "events").select("user_id", "ts")
    told = runs.drain(state.session_stream(events, late_minutes=ANY_LATENESS))
    return state.current_sessions(told).select(
        "user_id", "session_no", F.unix_micros("started").alias("started_us"), F.unix_micros("updated").alias("updated_us"), "events"
    )


@query("stream_delta_assembly", f"""WITH {sq.SQL_ENVELOPES} SELECT request_id, CASE seq % 3 WHEN 0 THEN 's1' WHEN 1 THEN 'doc.py' ELSE 'answer' END AS scope,
  string_agg(text, '' ORDER BY seq) AS text FROM accepted a WHERE type = 'delta'
  AND EXISTS (SELECT 1 FROM accepted e WHERE e.request_id = a.request_id AND e.type IN ('complete', 'done', 'cancelled', 'error')) GROUP BY ALL""")
def stream_delta_assembly(spark, sf):
    part = F.col("seq") % 3
    scope = ss.scope_of(F.when(part == 0, "segment:s1").when(part == 1, "").otherwise(None), F.when(part == 1, "doc.py"), F.lit("answer"))
    gated = state.gate_stream(sq.shape_envelopes(runs.table_stream(spark, sf, "events")), ttl_minutes=None)
    texts = state.delta_stream(gated.withColumn("scope", scope), ttl_minutes=None)
    return runs.drain(texts).select("request_id", "scope", "text")


@query("stream_generation_metrics", SQL_METRICS)
def stream_generation_metrics(spark, sf):
    """The last word of the rolling metrics, which follow every micro-batch."""
    told = runs.drain(state.metric_stream(sq.generation_samples(runs.table_stream(spark, sf, "events")).withColumn("ord", F.unix_micros("ts") * 1000 + F.col("event_id") % 1000), "task"))
    return told.groupBy(F.col("key").alias("task")).agg(F.max_by(F.struct(*state.METRICS), "last_ord").alias("m")).select("task", "m.*")


@query("stream_citation_filter", """WITH frag AS (SELECT conv_id, turn * 2 + h AS seq, CASE h WHEN 0 THEN text || ' [E' ELSE turn || '] and [E1' || '] [Ex' END AS t FROM conversations, (VALUES (0), (1)) v(h)),
whole AS (SELECT conv_id, string_agg(t, '' ORDER BY seq) AS t FROM frag GROUP BY 1)
SELECT conv_id::VARCHAR AS request_id, CASE WHEN conv_id % 2 = 0 THEN regexp_replace(t, '\\[E(0|3|4|5|6|7|8|9)\\]', '', 'g')
  ELSE regexp_replace(t, '\\[E(0|2|4|5|6|7|8|9)\\]', '', 'g') END AS text FROM whole""")
def stream_citation_filter(spark, sf):
    said = runs.table_stream(spark, sf, "conversations")
    piece = F.when(F.col("h") == 0, F.concat("text", F.lit(" [E"))).otherwise(F.concat(F.col("turn").cast("string"), F.lit("] and [E1] [Ex")))
    fragments = said.withColumn("h", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.col("conv_id").cast("string").alias("request_id"), (F.col("turn") * 2 + F.col("h")).alias("seq"), piece.alias("text"),
        F.array(F.lit("E1"), F.when(F.col("conv_id") % 2 == 0, F.lit("E2")).otherwise(F.lit("E3"))).alias("valid"),
    )
    parts = runs.drain(state.filter_stream(fragments, ttl_minutes=None))
    return parts.groupBy("request_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text")
    )


@query("stored_facts_refresh", "SELECT source AS project_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, sha256(text) AS source_hash, sha256(text) AS content_hash FROM documents")
def stored_facts_refresh(spark, sf):
    """An older store, texts and all, brought up to the listing."""
    files, stored = snapshot_pair(spark, sf)
    store = FactStore(spark, f"{shared_dir(spark).rstrip('/')}/codequarry-store-{uuid.uuid4().hex}", buckets=2)
    build_facts(store, stored, {})
    refresh_facts(store, files, F.sha2("content", 256))
    return store.read("files").select("project_id", "path", "source_hash", F.sha2("content", 256).alias("content_hash"))
