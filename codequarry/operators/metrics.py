"""Rolling generation and index metrics, coverage and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators.topk import top_k
from codequarry.options import DEFAULTS


def rolling(rows: DataFrame, keys: list[str], newest_first: list[Column], capacity: int = DEFAULTS.metric_capacity) -> DataFrame:
    """The last `capacity` samples of each ring."""
    return top_k(rows, keys, newest_first, capacity, "_n").drop("_n")


def half_even(value: Column, digits: int) -> Column:
    """Round the scaled double to the nearest integer, ties to even."""
    return F.rint(value * 10**digits) / 10**digits


def _median(column: Column, digits: int = 2) -> Column:
    return F.coalesce(half_even(F.median(column), digits), F.lit(0.0))


def generation_metrics(samples: DataFrame, keys: list[str]) -> DataFrame:
    rate = F.when(~F.col("cache_hit") & (F.col("duration_ms") > 0), F.col("output_tokens") / (F.col("duration_ms") / 1000))
    return samples.groupBy(*keys).agg(
        F.count("*").alias("count"),
        half_even(F.count_if("cache_hit") / F.count("*"), 4).alias("cache_hit_rate"),
        *[
            _median(F.col(name)).alias(f"median_{name}")
            for name in ("queue_ms", "ttft_ms", "duration_ms", "context_tokens", "output_tokens")
        ],
        _median(rate).alias("median_tokens_per_second"),
    )


def index_metrics(samples: DataFrame, keys: list[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(
        F.count("*").alias("count"), _median(F.col("duration_ms")).alias("median_duration_ms"),
        F.sum("files").alias("files"), F.sum("failed").alias("failed"),
    )


def coverage_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, half_even(done * 100 / total, 0).cast("int")).otherwise(F.lit(100))


def retrieval_gate(truth: DataFrame, top: DataFrame, keys: list[str]) -> DataFrame:
    """truth(request_id = the right symbol, current_file = its path) against the first answer."""
    judged = truth.join(top, "request_id", "left")
    hit = F.coalesce(F.col("symbol_id") == F.col("request_id"), F.lit(False))
    wrong = ~F.col("path").eqNullSafe(F.col("current_file"))
    return judged.groupBy(*keys).agg(
        F.count("*").alias("questions"), F.round(F.avg(hit.cast("int")), 6).alias("recall_at_1"),
        F.count_if(wrong).alias("false_exact"),
    )
