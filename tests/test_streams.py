"""Keyed streams over several micro-batches, with late rows, against their batch twins."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codequarry.operators import metrics, sessions
from codequarry.streaming import runs, state

START = datetime(2024, 1, 1)


def in_batches(spark, tmp_path, frame, order, parts):
    """A stream that reads `parts` files, one per micro-batch, dealt by ranges of `order`."""
    source = str(tmp_path / "in")
    size = frame.count() // parts + 1
    for part in range(parts):
        frame.filter((F.col(order) >= part * size) & (F.col(order) < (part + 1) * size)).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)


def visits(seed, users, n, late):
    """Events in order of arrival; times lie up to `late` minutes behind the order."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        minute = i * 2 - rng.choice((0, 0, 0, rng.randint(0, late)))
        rows.append((0 if i % 3 == 0 else rng.randint(1, users), START + timedelta(minutes=max(minute, 0), seconds=rng.randint(0, 59)), i))
    return rows


@pytest.mark.parametrize("ttl", [15, 45])
def test_sessions_with_late_rows_equal_batch(spark, tmp_path, ttl):
    frame = spark.createDataFrame(visits(3, 12, 900, 200), "user_id long, ts timestamp, i long")
    told = runs.drain(state.session_stream(in_batches(spark, tmp_path, frame, "i", 4).select("user_id", "ts"), ttl, late_minutes=300))
    assert told.filter("gone").count() > 0
    columns = ["user_id", "session_no", "started", "updated", "events"]
    expected = sorted(tuple(r) for r in sessions.sessions(frame.select("user_id", "ts"), ttl).select(*columns).collect())
    assert sorted(tuple(r) for r in state.current_sessions(told).select(*columns).collect()) == expected


def test_ended_sessions_leave_the_state(spark, tmp_path):
    rows = [(u, START + timedelta(hours=h), h) for h in range(60) for u in ([1, 2] if h < 3 else [3])]
    frame = spark.createDataFrame(rows, "user_id long, ts timestamp, i long")
    stream = state.session_stream(in_batches(spark, tmp_path, frame, "i", 3).select("user_id", "ts"), 90)
    place = str(tmp_path / "place")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", runs._ROCKS)
    query = (stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    # What the last batches hold is user 3 alone; 1 and 2 ended days before.
    held = spark.read.format("statestore").option("stateVarName", "open").load(f"{place}/state")
    assert {row["key"]["user_id"] for row in held.select("key").collect()} <= {3}


ACCEPTED = "request_id string, arrived timestamp, seq int, type string, scope string, text string, i long"


def test_deltas_over_batches_equal_batch(spark, tmp_path):
    rng = random.Random(5)
    rows, seqs = [], {}
    for i in range(800):
        request = "hot" if i % 3 == 0 else f"r{rng.randint(0, 15)}"
        if seqs.get(request) == "ended":
            continue
        seqs[request] = seqs.get(request, -1) + 1
        kind = "complete" if rng.random() < 0.02 else rng.choice(("delta", "delta", "status"))
        rows.append((request, START + timedelta(seconds=i), seqs[request], kind, f"s{i % 3}", rng.choice((f"t{i} ", "", None, "é\n")), len(rows)))
        if kind == "complete":
            seqs[request] = "ended"
    frame = spark.createDataFrame(rows, ACCEPTED)
    found = runs.drain(state.delta_stream(in_batches(spark, tmp_path, frame, "i", 4).drop("i"), ttl_minutes=120))
    got = {(r.request_id, r.scope): r.text for r in found.filter("complete").collect()}
    ended = frame.filter("type = 'complete'").select("request_id")
    batch = sessions.assemble_deltas(frame.filter("type = 'delta'").join(ended, "request_id"))
    assert got == {(r.request_id, r.scope): r.text for r in batch.collect()} and len(got) > 10


def test_expired_requests_tell_what_they_have(spark, tmp_path):
    rows = [("a", START, 0, "delta", "s", "left", 0), ("b", START + timedelta(hours=5), 0, "delta", "s", "x", 1), ("b", START + timedelta(hours=9), 1, "done", "s", None, 2)]
    frame = spark.createDataFrame(rows, ACCEPTED)
    found = runs.drain(state.delta_stream(in_batches(spark, tmp_path, frame, "i", 3).drop("i"), ttl_minutes=60))
    assert sorted((r.request_id, r.text, r.complete) for r in found.collect())[0] == ("a", "left", False)


def test_finished_requests_leave_the_gate(spark, tmp_path):
    """A straggler after the end is stopped while the request is known; after the expiry its name is free again."""
    at = [0, 1, 2, 600, 1200, 1201]
    rows = [(i, "q" if i in (0, 1, 2, 5) else "other", START + timedelta(minutes=m), "j2" if i == 5 else "j", i, "complete" if i == 1 else "delta", "t") for i, m in enumerate(at)]
    frame = spark.createDataFrame(rows, state.ENVELOPE)
    found = runs.drain(state.gate_stream(in_batches(spark, tmp_path, frame, "event_id", 6)))
    assert sorted(r.event_id for r in found.collect()) == [0, 1, 3, 4, 5]


def test_rolling_metrics_equal_batch_after_every_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [("a" if i % 3 else "b", i, rng.random() < 0.2, rng.random() * 9, rng.random() * 99, rng.choice((0.0, rng.random() * 900)), rng.randint(1, 99), rng.randint(0, 50)) for i in range(700)]
    frame = spark.createDataFrame(rows, "task string, ord long, cache_hit boolean, queue_ms double, ttft_ms double, duration_ms double, context_tokens int, output_tokens int")
    found = runs.drain(state.metric_stream(in_batches(spark, tmp_path, frame, "ord", 4), "task", capacity=120))
    told = found.collect()
    assert len(told) == 8
    for row in told:
        upto = frame.filter((F.col("ord") <= row.last_ord) & (F.col("task") == row.key))
        batch = metrics.generation_metrics(metrics.rolling(upto, ["task"], [F.col("ord").desc()], 120), ["task"]).first()
        assert [row[name] for name in state.METRICS] == pytest.approx([batch[name] for name in state.METRICS], abs=0.0101), row


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_that_is_a_folder_of_files_streams_whole(spark, tmp_path, files):
    rows = spark.range(50).withColumn("text", F.concat(F.lit("t"), "id"))
    rows.repartition(files).write.parquet(str(tmp_path / "said.parquet"))
    rows.write.parquet(str(tmp_path / "other.parquet"))
    assert {tuple(r) for r in runs.drain(runs.table_stream(spark, str(tmp_path), "said", 2)).collect()} == {tuple(r) for r in rows.collect()}
