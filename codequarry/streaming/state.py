"""Keyed stream processors: envelope gate, citation filter, sessions, delta assembly, rolling metrics and anchors.

Each key's state is a few values, never its history; the batch twins are in `operators.sessions`
and `operators.evidence`.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codequarry.operators.sessions import TERMINAL
from codequarry.options import DEFAULTS

# The driver's own runner of stateful processors sees no shipped archive, so they travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENVELOPE = "event_id bigint, request_id string, arrived timestamp, job_id string, seq int, type string, text string"
_MARK = re.compile(r"\[(E\d+)\]")
_OPEN_MARK = re.compile(r"\[(?:[Ee]\d*)?$")
# Fixed value: a longer unfinished mark is ordinary text.
OPEN_MARK_CHARS = 20
# How far behind the newest event rows may come in before they count as late.
LATE_MINUTES = 10


def _in_order(rows: Iterator[Row], by: list[str]) -> list[Row]:
    """One key's rows of one micro-batch, nulls last.

    Most keys have a few rows only, for which plain rows take a tenth of the time of a frame.
    """
    return sorted(rows, key=lambda row: [(row[name] is None, row[name]) for name in by])


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """One key's rows of one micro-batch; the source's files or offsets per trigger bound how many those are."""
    return pd.concat(list(rows)).sort_values(by, kind="stable", ignore_index=True)


class Expiring(StatefulProcessor):
    """Forgets a key once the watermark has passed its last event by the TTL; without a TTL it is kept for ever.

    Expiry goes by event time, so a stream that is drained to its end stops, and a replay gives the
    same rows. A key has one timer, which moves on with its events.
    """

    def __init__(self, ttl_minutes: int | None = None):
        self.ttl_ms = ttl_minutes * 60_000 if ttl_minutes else None

    def keep_until(self, newest: pd.Timestamp) -> None:
        if self.ttl_ms is None:
            return
        at = int(newest.timestamp() * 1000) + self.ttl_ms
        known = list(self.handle.listTimers())
        if not known or max(known) < at:
            for old in known:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)

    def due(self, timer_values) -> bool:
        """The key expired before this batch: its timer fires after the rows of the batch only."""
        return self.ttl_ms is not None and any(at <= timer_values.getCurrentWatermarkInMs() for at in self.handle.listTimers())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _with_lateness(rows: DataFrame, at: str, ttl_minutes: int | None, late_minutes: int) -> tuple[DataFrame, str]:
    """Rows with a watermark and the time mode; a stream without expiry needs neither."""
    return (rows.withWatermark(at, f"{late_minutes} minutes"), "EventTime") if ttl_minutes else (rows, "None")


class EnvelopeGate(Expiring):
    """Binds a request to its first job and lets only growing seq through, up to a terminal envelope.

    A finished request keeps one flag until it expires, so that stragglers don't open it again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gate", "job_id string, last_seq int, done boolean")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        batch = _in_order(rows, ["arrived", "seq", "event_id"])
        if self.due(timer_values):
            self.state.clear()
        self.keep_until(batch[-1]["arrived"])
        # Every call of the state is a round trip, so a key reads once and writes once, if it has changed.
        held = self.state.get()
        job, last, done = held or (batch[0]["job_id"], -1, False)
        if done:
            return
        kept = []
        for row in batch:
            if job is not None and row["job_id"] == job and row["seq"] is not None and row["seq"] > last:
                kept.append(row)
                last, done = row["seq"], row["type"] in TERMINAL
                if done:
                    break
        if kept or held is None:
            self.state.update((job, last, done))
        yield from kept


def gate_stream(envelopes: DataFrame, ttl_minutes: int | None = DEFAULTS.session_ttl_minutes, late_minutes: int = LATE_MINUTES) -> DataFrame:
    """Envelopes later than the watermark are dropped; without a TTL none is."""
    timed, mode = _with_lateness(envelopes, "arrived", ttl_minutes, late_minutes)
    return timed.groupBy("request_id").transformWithState(
        statefulProcessor=EnvelopeGate(ttl_minutes), outputStructType=ENVELOPE, outputMode="Append", timeMode=mode
    )


def feed(held: str, chunk: str, valid: set[str]) -> tuple[str, str, list[str]]:
    """(text to emit, text to hold, unknown ids) after one more fragment."""
    text = held + chunk
    tail = _OPEN_MARK.search(text)
    cut_at = tail.start() if tail and len(tail.group()) <= OPEN_MARK_CHARS else len(text)
    unknown = [e for e in _MARK.findall(text[:cut_at]) if e not in valid]
    emitted = _MARK.sub(lambda m: m.group() if m[1] in valid else "", text[:cut_at])
    return emitted, text[cut_at:], unknown


class CitationFilter(Expiring):
    """Drops unknown [E#] marks even when a fragment ends inside one. A null text ends the stream.

    Every fragment brings the ids that are valid for its request, and with a TTL the time `sent`.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "text string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        batch = _sorted(rows, ["seq"])
        if self.due(timer_values):
            self.state.clear()
        if self.ttl_ms is not None:
            self.keep_until(batch["sent"].max())
        held = self.state.get()[0] if self.state.exists() else ""
        out = []
        for seq, text, valid in batch[["seq", "text", "valid"]].itertuples(index=False):
            if text is None:
                emitted, held, unknown = held, "", []
            else:
                emitted, held, unknown = feed(held, text, set(valid))
            out.append((key[0], seq, emitted, ",".join(unknown)))
        self.state.update((held,))
        yield pd.DataFrame(out, columns=["request_id", "seq", "text", "unknown"])


def filter_stream(fragments: DataFrame, ttl_minutes: int | None = None, late_minutes: int = LATE_MINUTES) -> DataFrame:
    """fragments(request_id, seq, text, valid ARRAY<STRING>[, sent]) to their text without unknown marks.

    Expiry needs the time `sent` of every fragment.
    """
    timed, mode = _with_lateness(fragments, "sent", ttl_minutes, late_minutes)
    return timed.groupBy("request_id").transformWithStateInPandas(
        statefulProcessor=CitationFilter(ttl_minutes), outputStructType="request_id string, seq bigint, text string, unknown string",
        outputMode="Append", timeMode=mode,
    )


def _joined_spans(spans: list[tuple], ttl: pd.Timedelta) -> list[tuple]:
    """(started, updated, events) spans with gaps of at most the TTL between them become one."""
    merged: list[tuple] = []
    for started, updated, events in sorted(spans):
        if merged and started - merged[-1][1] <= ttl:
            first, last, n = merged[-1]
            merged[-1] = (first, max(last, updated), n + events)
        else:
            merged.append((started, updated, events))
    return merged


class SessionState(Expiring):
    """A user's sessions that can still change: one ends when the watermark is past its last event by the TTL.

    A late row extends a session at either end, or joins two. Rows say what a session, known by its
    start, has become; `gone` ones that a start is no longer one. Events become spans frame by frame,
    so the state and the work of a batch grow with the sessions, not with the events.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("open", "started timestamp, updated timestamp, events bigint")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        ttl = pd.Timedelta(milliseconds=self.ttl_ms)
        known = [(pd.Timestamp(a), pd.Timestamp(b), n) for a, b, n in self.state.get()] if self.state.exists() else []
        spans = list(known)
        for frame in rows:
            at = frame["ts"].sort_values(ignore_index=True)
            pieces = at.groupby((at.diff() > ttl).cumsum()).agg(["min", "max", "size"])
            spans = _joined_spans(spans + list(pieces.itertuples(index=False, name=None)), ttl)
        self._hold(spans)
        before, now = set(known), {span[0] for span in spans}
        changed = [(key[0], *span, False) for span in spans if span not in before]
        changed += [(key[0], *span, True) for span in known if span[0] not in now]
        yield pd.DataFrame(changed, columns=["user_id", "started", "updated", "events", "gone"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Sessions past the watermark have been told already; no row that is still let in can reach them.
        limit = pd.Timestamp(timerValues.getCurrentWatermarkInMs() - self.ttl_ms, unit="ms")
        self._hold([span for span in ((pd.Timestamp(a), pd.Timestamp(b), n) for a, b, n in self.state.get()) if span[1] > limit])
        yield from ()

    def _hold(self, spans: list[tuple]) -> None:
        if not spans:
            self.state.clear()
            return
        self.state.put([(a.to_pydatetime(), b.to_pydatetime(), int(n)) for a, b, n in spans])
        # The next to end is the earliest; one timer is enough.
        at = int(spans[0][1].timestamp() * 1000) + self.ttl_ms + 1
        known = list(self.handle.listTimers())
        if at not in known:
            for old in known:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)


def session_stream(events: DataFrame, ttl_minutes: int = DEFAULTS.session_ttl_minutes, late_minutes: int = LATE_MINUTES) -> DataFrame:
    """What sessions have become, micro-batch by micro-batch; `current_sessions` reads the latest of each."""
    timed, mode = _with_lateness(events, "ts", ttl_minutes, late_minutes)
    return timed.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=SessionState(ttl_minutes),
        outputStructType="user_id bigint, started timestamp, updated timestamp, events bigint, gone boolean",
        outputMode="Append", timeMode=mode,
    )


def current_sessions(told: DataFrame) -> DataFrame:
    """user_id, session_no, started, updated and events from the rows of `session_stream`, in any order."""
    latest = told.groupBy("user_id", "started").agg(
        F.max("updated").alias("updated"), F.max("events").alias("events"), F.max("gone").alias("gone")
    ).filter("NOT gone")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("started"))
    return latest.select("user_id", number.cast("bigint").alias("session_no"), "started", "updated", "events")


class DeltaAssembly(Expiring):
    """Collects the fragments of a request and gives one text per scope when its terminal envelope comes.

    Fragments are appended to the state, which is read once: at the end, or when the request expires.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("pieces", "scope string, seq int, text string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        batch = _in_order(rows, ["seq"])
        if self.due(timer_values):
            yield from self._told(key, False)
        pieces = [(row["scope"], row["seq"], row["text"]) for row in batch if row["type"] == "delta" and row["text"]]
        if any(row["type"] in TERMINAL for row in batch):
            yield from self._told(key, True, pieces)
            return
        if pieces:
            self.state.appendList(pieces)
        self.keep_until(max(row["arrived"] for row in batch))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._told(key, False)

    def _told(self, key, complete: bool, pieces: Iterable[tuple] = ()) -> Iterator[Row]:
        """One text per scope from what is held and the pieces that have just come."""
        texts: dict[str, list[str]] = {}
        for scope, _, text in sorted([*self.state.get(), *pieces], key=lambda piece: (piece[1] is None, piece[1])):
            if scope is not None:
                texts.setdefault(scope, []).append(text)
        for scope in sorted(texts):
            yield Row(request_id=key[0], scope=scope, text="".join(texts[scope]), complete=complete)
        self.state.clear()


def delta_stream(accepted: DataFrame, ttl_minutes: int | None = DEFAULTS.session_ttl_minutes, late_minutes: int = LATE_MINUTES) -> DataFrame:
    """accepted(request_id, arrived, seq, type, scope, text), as the gate lets them through, to one text per scope.

    A text comes with the terminal envelope of its request; what expires without one is not `complete`.
    """
    timed, mode = _with_lateness(accepted, "arrived", ttl_minutes, late_minutes)
    return timed.groupBy("request_id").transformWithState(
        statefulProcessor=DeltaAssembly(ttl_minutes), outputStructType="request_id string, scope string, text string, complete boolean",
        outputMode="Append", timeMode=mode,
    )


class MetricRing(StatefulProcessor):
    """The last samples of a key, at most `capacity`, and their medians after every micro-batch."""

    SAMPLE = "ord bigint, cache_hit boolean, queue_ms double, ttft_ms double, duration_ms double, context_tokens double, output_tokens double"
    COLUMNS = ["ord", "cache_hit", "queue_ms", "ttft_ms", "duration_ms", "context_tokens", "output_tokens"]

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("ring", self.SAMPLE)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        ring = pd.DataFrame(list(self.state.get()), columns=self.COLUMNS) if self.state.exists() else None
        for frame in rows:
            fresh = frame[self.COLUMNS]
            # Only so many samples are ever held, however many a batch brings.
            ring = (fresh if ring is None else pd.concat([ring, fresh])).sort_values("ord", kind="stable").tail(self.capacity)
        self.state.put([tuple(v.item() if hasattr(v, "item") else v for v in row) for row in ring.astype(object).itertuples(index=False)])
        yield pd.DataFrame([(key[0], int(ring["ord"].iloc[-1]), *self._metrics(ring))], columns=["key", "last_ord", *METRICS])

    def _metrics(self, ring: pd.DataFrame) -> list:
        hit = ring["cache_hit"].astype(bool)
        timed = ring[~hit & (ring["duration_ms"] > 0)]
        rate = timed["output_tokens"] / (timed["duration_ms"] / 1000)
        medians = [self._rounded(ring[name].median(), 2) for name in self.COLUMNS[2:]]
        return [len(ring), self._rounded(hit.mean(), 4), *medians, self._rounded(rate.median(), 2)]

    @staticmethod
    def _rounded(value: float, digits: int) -> float:
        # Python rounds the scaled double half to even.
        return 0.0 if pd.isna(value) else round(value * 10**digits) / 10**digits

    def close(self) -> None:
        pass


METRICS = [
    "count", "cache_hit_rate", "median_queue_ms", "median_ttft_ms", "median_duration_ms", "median_context_tokens", "median_output_tokens",
    "median_tokens_per_second",
]


def metric_stream(samples: DataFrame, key: str, capacity: int = DEFAULTS.metric_capacity) -> DataFrame:
    """samples(<key>, ord, cache_hit, queue_ms, ...) to the rolling metrics of every key after each micro-batch."""
    as_doubles = [F.col(name).cast("double").alias(name) for name in MetricRing.COLUMNS[2:]]
    plain = samples.select(F.col(key).cast("string").alias("key"), F.col("ord").cast("bigint").alias("ord"), "cache_hit", *as_doubles)
    return plain.groupBy("key").transformWithStateInPandas(
        statefulProcessor=MetricRing(capacity),
        outputStructType="key string, last_ord bigint, count bigint, " + ", ".join(f"{name} double" for name in METRICS[1:]),
        outputMode="Append", timeMode="None",
    )


class AnchorState(StatefulProcessor):
    """The last anchors of a conversation: newest per (path, span, symbol), at most `keep`."""

    KEY = ["path", "start_line", "end_line", "symbol"]

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("anchors", "ord bigint, path string, start_line int, end_line int, source_hash string, symbol string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        columns = ["ord", "path", "start_line", "end_line", "source_hash", "symbol"]
        fresh = _sorted(rows, ["ord"])[columns]
        fresh = fresh.assign(path=fresh["path"].str.replace("\\", "/"))
        fine = fresh[(fresh["path"] != "") & (fresh["start_line"] >= 1) & (fresh["end_line"] >= fresh["start_line"])]
        known = pd.DataFrame([tuple(row) for row in self.state.get()], columns=columns) if self.state.exists() else fine.iloc[:0]
        merged = pd.concat([known, fine]) if len(known) else fine
        merged = merged.drop_duplicates(self.KEY, keep="last").sort_values("ord").tail(self.keep)
        if len(merged):
            self.state.put([tuple(None if pd.isna(v) else v for v in row) for row in merged.itertuples(index=False)])
            yield merged.assign(conversation_id=key[0])[["conversation_id", *columns]]

    def close(self) -> None:
        pass


def anchor_stream(anchors: DataFrame, keep: int = DEFAULTS.anchors) -> DataFrame:
    return anchors.groupBy("conversation_id").transformWithStateInPandas(
        statefulProcessor=AnchorState(keep),
        outputStructType="conversation_id bigint, ord bigint, path string, start_line int, end_line int, source_hash string, symbol string",
        outputMode="Append", timeMode="None",
    )
