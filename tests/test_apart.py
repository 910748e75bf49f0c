"""Parsing leaves nothing behind in the worker, and its helper processes are replaced."""

import os

import pyarrow as pa
import pytest

from codequarry.operators import facts as fa
from codequarry.operators.apart import Apart


def resident_mb():
    with open("/proc/self/statm") as handle:
        return int(handle.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def test_names_of_parsed_files_do_not_stay_in_the_worker():
    def batch(start):
        texts = ["\n".join(f"def a_name_of_its_own_{i}_{j}(): pass" for j in range(500)) for i in range(start, start + 100)]
        return pa.RecordBatch.from_pylist(
            [{"project_id": "p", "file_id": i, "path": "a.py", "module": "a", "content": text} for i, text in enumerate(texts)]
        )

    def rows(batches):
        return sum(b.num_rows for b in fa.tagged_rows(batches, fa.FILE_KEYS, fa.FACT_FIELDS, lambda r: fa.file_facts(r["content"], r["module"], False)))

    rows(batch(100 * k) for k in range(700, 704))
    before = resident_mb()
    assert rows(batch(100 * k) for k in range(1, 7)) == 300_000
    assert resident_mb() - before < 15


def test_helpers_are_replaced_by_input_and_tell_errors():
    with Apart(lambda text: (os.getpid(), text.upper()), limit=10) as called:
        answers = [called(text, len(text)) for text in ("abcdef", "ghijkl", "m", "n")]
    assert [text for _, text in answers] == ["ABCDEF", "GHIJKL", "M", "N"]
    pids = [pid for pid, _ in answers]
    assert pids[0] == pids[1] != pids[2] == pids[3] and os.getpid() not in pids
    with Apart(lambda text: 1 // 0) as called, pytest.raises(RuntimeError, match="ZeroDivisionError"):
        called("a", 1)
