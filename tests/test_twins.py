"""Every registered query against its SQL twin on the smallest tables.

The slowest ones run only with TWINS=all; tests/run_twins.py checks any of them by name.
"""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry_module
from twins import compare

DIRECTORY = "/root/testdata/sf0.001"
SLOW = {
    "call_resolution", "resolution_by_confidence", "hybrid_retrieve", "evidence_preflight", "preflight_questions", "related_sources",
    "entry_references", "project_overview", "resolve_expression", "text_search_with_fallback", "python_outline", "skeleton_text",
    "stored_facts_refresh", "stream_sessions", "stream_citation_filter", "transitive_file_dependencies",
}
JOBS, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.mark.skipif(not Path(DIRECTORY).exists(), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(JOBS if os.environ.get("TWINS") == "all" else set(JOBS) - SLOW))
def test_query_equals_its_sql(spark, name):
    if name in SQL:
        assert compare(spark, JOBS[name], SQL[name], DIRECTORY) == []
    else:
        assert JOBS[name](spark, DIRECTORY).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(JOBS)
