"""One registered query per operator, on whole tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import (
    centroid_clustering, decontaminate, html_text, language_id, line_dedup, lm_score, minhash, mixing, pii, quality_rules, simhash, spelling, token_counts,
)
from codequarry.llm.sql import DECONTAMINATE, MINHASH, MIX, QUALITY, cluster_sql

Job = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.assess(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "longest",
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    counts = [of_kind(kind) for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score_corpus(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The installed files' description gives the place and the pattern; both are parameters of the operator.
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return token_counts.count(docs, token_counts.derived_edits(F.col("text")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    trees = language_id.train(docs, lambda doc_id: ~F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False)))
    return language_id.predict(docs, trees).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classed = simhash.classes(_table(spark, sf_dir, "documents"))
    return classed.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.with_inertia(centroid_clustering.cluster(_table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Job]:
    jobs = (
        op1_quality_rules, op2_line_dedup, op3_decontamination, op4_mixing, op5_pii,
        op6_html_text, op7_lm_score, op8_token_counts, op9_language_id, op10_simhash,
        op11_spelling_variants, op12_minhash, op13_centroid_clustering,
    )
    return {job.__name__: job for job in jobs}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": QUALITY, "op3_decontamination": DECONTAMINATE, "op4_mixing": MIX, "op12_minhash": MINHASH, "op13_centroid_clustering": cluster_sql()}
