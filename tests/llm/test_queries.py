"""The registered queries on the smallest tables: SQL where there is some, a brute-force version elsewhere."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import brute
import corpus_pipeline
from pyspark.sql import functions as F
from twins import compare

from codequarry.llm import line_dedup, mixing, queries, quality_rules

DIRECTORY = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIRECTORY).exists(), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, queries.queries()[name], queries.oracle_sql()[name], DIRECTORY) == []


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DIRECTORY}/documents.parquet").orderBy("doc_id").select("doc_id", "text", "lang", "source").collect()]


def run(spark, name):
    return {r["doc_id"]: r for r in queries.queries()[name](spark, DIRECTORY).collect()}


def test_op2(spark, documents):
    got = run(spark, "op2_line_dedup")
    want = brute.repeated_runs([t for _, t, *_ in documents], line_dedup.pieces, line_dedup.RUN_WORDS)
    assert [got[i]["text"] for i, *_ in documents] == want
    assert sum(r["n_gone"] > 0 for r in got.values()) > 0


def test_op5(spark, documents):
    got = run(spark, "op5_pii")
    for i, text, *_ in documents:
        spans = brute.pii_base(text)
        assert got[i]["base_sha256"] == brute.sha(spans)
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s.startswith(k) for s in spans) for k in ("email", "ip", "card", "phone")]
        assert set(spans) <= set(got[i]["spans"].split(","))


def test_op6(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DIRECTORY}/pages.parquet").collect()}
    got = queries.queries()["op6_html_text"](spark, DIRECTORY).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        assert r["n_chars"] == len(r["text"])
        assert r["text"] == brute.article_text(pages[r["page_id"]]["html"])


def test_op7(spark, documents):
    got = run(spark, "op7_lm_score")
    want, n = brute.language_model([(i, t, brute.held_out(i, 7)) for i, t, *_ in documents], 200.0)
    for i, (tokens, known, base, score) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-6) and r["score"] == pytest.approx(score, rel=1e-3)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op8(spark, documents):
    got = run(spark, "op8_token_counts")
    assert len(got) == len(documents)
    assert all(r["n_reencoded"] < 120 for r in got.values())


def test_op9(spark, documents):
    got = run(spark, "op9_language_id")
    held = [(got[i]["lang_pred"], lang) for i, text, lang, _ in documents if got[i]["held_out"] and len(text or "") > 40]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_op10(spark, documents):
    got = run(spark, "op10_simhash")
    prints = [brute.simhash(t) for _, t, *_ in documents]
    want = brute.classes(prints)
    for k, (i, *_) in enumerate(documents):
        assert got[i]["fingerprint"] == f"{prints[k]:016x}"
        assert got[i]["component_id"] == documents[want[k]][0]


def test_pipeline_against_its_stages(spark, documents):
    """Every stage's rows from plain versions of its rule, the mix from the sizes it was given."""
    good = {r["doc_id"] for r in quality_rules.assess(spark.read.parquet(f"{DIRECTORY}/documents.parquet")).filter("kept").collect()}
    kept = [(i, t, s) for i, t, _, s in documents if i in good]
    assert all(not brute.quality_base(t)[5] for _, t, _ in kept)
    texts = brute.repeated_runs([t for _, t, _ in kept], line_dedup.pieces, line_dedup.RUN_WORDS)
    firsts = set(brute.classes([brute.simhash(t) for t in texts]))
    single = [(kept[k][0], texts[k], kept[k][2]) for k in range(len(kept)) if k in firsts]
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{DIRECTORY}/benchmark.parquet").collect()]
    clean = [row for row, (_, hit, _) in zip(single, brute.decontaminate([t for _, t, _ in single], bench), strict=True) if hit == 0]
    docs = spark.createDataFrame(clean, "doc_id bigint, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    got = corpus_pipeline.run(spark, DIRECTORY)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    found = {(r["doc_id"], r["text"]): r["n"] for r in got.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    assert found == {(i, t): copies[i] for i, t, _ in clean if copies[i]}
