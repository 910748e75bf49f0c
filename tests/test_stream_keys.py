"""Gate and delta assembly take plain rows and ask their state a fixed number of times per key."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row

from codequarry.streaming import state

START = datetime(2024, 1, 1)


class Held:
    """A value or list state that counts how often it is asked."""

    def __init__(self, value):
        self.value, self.calls = value, 0

    def get(self):
        self.calls += 1
        return iter(list(self.value)) if isinstance(self.value, list) else self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def appendList(self, values):
        self.calls, self.value = self.calls + 1, [*self.value, *values]

    def clear(self):
        self.calls, self.value = self.calls + 1, type(self.value)() if isinstance(self.value, list) else None


def envelope(event_id, job, seq, kind="delta", at=0):
    return Row(event_id=event_id, request_id="q", arrived=START + timedelta(seconds=at), job_id=job, seq=seq, type=kind, text="t")


@pytest.mark.parametrize("many", [1, 400])
def test_gate_reads_and_writes_once(many):
    gate = state.EnvelopeGate()
    gate.state = Held(None)
    first = [envelope(n, "a", n, at=n) for n in range(many)] + [envelope(900, "b", 990, at=900), envelope(901, "a", None, at=901), envelope(902, "a", -1, at=902)]
    assert [r.event_id for r in gate.handleInputRows(("q",), iter(reversed(first)), None)] == list(range(many))
    assert gate.state.calls == 2
    later = [envelope(1000, "a", many - 1, at=1000), envelope(1001, "a", 990, "complete", at=1001), envelope(1002, "a", 991, at=1002)]
    assert [r.event_id for r in gate.handleInputRows(("q",), iter(later), None)] == [1001]
    assert gate.state.value == ("a", 990, True) and gate.state.calls == 4
    assert list(gate.handleInputRows(("q",), iter([envelope(2000, "a", 999)]), None)) == []
    assert gate.state.calls == 5


def test_gate_without_a_job_lets_nothing_through():
    gate = state.EnvelopeGate()
    gate.state = Held(None)
    assert list(gate.handleInputRows(("q",), iter([envelope(1, None, 1), envelope(2, "a", 2, at=2)]), None)) == []
    assert gate.state.value == (None, -1, False)


def piece(seq, kind, scope, text):
    return Row(request_id="q", arrived=START, seq=seq, type=kind, scope=scope, text=text)


def test_deltas_are_told_once_with_what_came_last():
    texts = state.DeltaAssembly()
    texts.state = Held([])
    rows = [piece(2, "delta", "s", "b"), piece(1, "delta", "s", "a"), piece(3, "delta", "t", ""), piece(4, "delta", None, "x"), piece(5, "status", "s", "no")]
    assert list(texts.handleInputRows(("q",), iter(rows), None)) == [] and texts.state.calls == 1
    told = list(texts.handleInputRows(("q",), iter([piece(7, "done", "s", None), piece(6, "delta", "s", "c"), piece(0, "delta", "r", "é")]), None))
    assert told == [Row(request_id="q", scope="r", text="é", complete=True), Row(request_id="q", scope="s", text="abc", complete=True)]
    assert texts.state.calls == 3 and texts.state.value == []
