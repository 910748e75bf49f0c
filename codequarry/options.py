"""Limits and budgets shared by the operators, as one frozen parameter object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    # They decide which rows a result holds, so they must not drift.
    schema_version: int = 2
    max_file_bytes: int = 2_000_000
    chunk_lines: int = 80
    chunk_overlap: int = 10
    fts_terms: int = 20
    literal_terms: int = 8
    symbol_candidates: int = 12
    question_identifiers: int = 16
    page_size: int = 30
    cursor_max: int = 100_000
    argument_chars: int = 500
    span_lines: int = 200
    span_bytes: int = 65_536
    preview_lines: int = 80
    selection_lines: int = 400
    file_preview_lines: int = 40
    anchors: int = 16
    events: int = 64
    messages: int = 8
    metric_capacity: int = 500
    sessions: int = 64
    session_ttl_minutes: int = 120
    reports: int = 128
    segment_evidence: int = 18
    map_tokens: int = 900
    context_tokens: int = 16_384
    soft_ratio: float = 0.75
    hard_ratio: float = 0.90
    evidence_ceiling_tokens: int = 6_500
    dependency_depth: int = 2
    same_call_limit: int = 2
    parallel_reads: int = 3
    tool_calls: int = 8
    research_steps: int = 3
    # Buckets of a project's fingerprint; a change of this number changes every fingerprint.
    fingerprint_buckets: int = 1_024


DEFAULTS = Options()
