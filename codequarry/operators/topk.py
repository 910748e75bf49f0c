"""Per-key top-k, latest-per-key and budget cuts.

`row_number() <= k` plans as a WindowGroupLimit: every map task keeps only k rows of a key before
the shuffle, so a key holding a third of all rows still sends k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_first").drop("_first")


def first_of(df: DataFrame, keys: list[str], by: list[str], columns: list[str]) -> DataFrame:
    """Row with the smallest `by` per key as a plain aggregate, with map-side combining."""
    packed = F.min_by(F.struct(*columns), F.struct(*by)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*")


def within_budget(
    df: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: Column | int
) -> DataFrame:
    """Longest prefix of each (already bounded) list whose running cost stays within the budget."""
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    limit = F.lit(budget) if isinstance(budget, int) else budget
    return (
        df.withColumn("_used", F.sum(cost).over(running)).filter(F.col("_used") <= limit).drop("_used")
    )
