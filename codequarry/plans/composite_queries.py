"""Registered queries: the composites, built from the operators the other queries check one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import preflight, project_map
from codequarry.plans import corpora as co
from codequarry.plans import modules_corpus as mc
from codequarry.plans.registry import query
from codequarry.plans.search_queries import index
from codequarry.session import cut
from codequarry.sources.tables import load


def _gathered(spark, sf):
    files = co.file_lines(spark, sf, even=False)
    stored = files.select("project_id", "path", "language", "source_hash", "lines", "line_count")
    stored_index = index(spark, sf)
    corpus = preflight.Corpus(stored, *co.stored_outline(spark, sf), stored_index.places, index=stored_index)
    return preflight.gather(co.requests(spark, sf), corpus)


@query("evidence_preflight")
def evidence_preflight(spark, sf):
    rows, _ = _gathered(spark, sf)
    return rows.select(
        "request_id", "slot", "path", "start_line", "end_line", "relation", "symbol", F.round("score", 6).alias("score"), "resolution",
        F.sha2("content", 256).alias("content_hash"),
    )


@query("preflight_questions")
def preflight_questions(spark, sf):
    rows, verdict = _gathered(spark, sf)
    labelled = rows.groupBy("request_id").agg(F.count("*").alias("rows"), F.countDistinct("path").alias("paths"))
    return verdict.join(labelled, "request_id", "left")


@query("related_sources")
def related_sources(spark, sf):
    files = cut(mc.modules(spark, sf))
    rows = cut(project_map.extract_entries(files), ["fact"])
    key = F.col("s_suppkey").cast("string")
    asked = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("request_id"),
        F.concat(F.lit("shop/parts/p_"), F.floor(F.col("s_suppkey") / mc.PART_BLOCK).cast("string"), F.lit(".py")).alias("path"),
        F.concat(F.lit("thing = make_"), key, F.lit("()\nitem = Part"), key, F.lit("()\nitem.price()\n")).alias("code"),
    )
    return project_map.related_sources(asked, rows, files)


