"""Event-log lines (`event:` / `data:` pairs) to typed envelopes, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each envelope type must carry in its payload.
REQUIRED = {
    "evidence": ("items",),
    "delta": ("text", "target"),
    "status": ("state",),
    "complete": (),
    "cancelled": (),
    "error": ("code", "message"),
}
ENVELOPE = "job_id STRING, seq INT, type STRING, scope_id STRING, payload MAP<STRING, STRING>"


def parse(records: DataFrame, text: str = "value") -> DataFrame:
    """Adds event, envelope and problem; problem is null for a well-formed envelope."""
    data = F.regexp_extract(text, r"(?m)^data: ?(.*)$", 1)
    parsed = records.withColumn("event", F.regexp_extract(text, r"(?m)^event: ?(.*)$", 1)).withColumn(
        "envelope", F.from_json(data, ENVELOPE)
    )
    return parsed.withColumn("problem", problem(F.col("event"), F.col("envelope")))


def problem(event: Column, envelope: Column) -> Column:
    kind, payload = envelope["type"], envelope["payload"]
    lacking = F.lit(False)
    for name, fields in REQUIRED.items():
        for field in fields:
            lacking = lacking | ((kind == name) & F.try_element_at(payload, F.lit(field)).isNull())
    return (
        F.when(envelope.isNull() | envelope["job_id"].isNull() | envelope["scope_id"].isNull() | payload.isNull(), "malformed")
        .when(envelope["seq"].isNull() | (envelope["seq"] < 0), "bad_seq")
        .when(~F.coalesce(kind.isin(*REQUIRED), F.lit(False)), "unknown_type")
        .when((event != "") & (event != kind), "type_mismatch")
        .when(lacking, "bad_payload")
    )
