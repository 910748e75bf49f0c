"""Helpers of the training-data operators: columns by exact name, row keys, bound sub-expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word rules: space and the five ASCII controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Columns by exact name, whatever else the frame holds.

    Spark resolves names without case, so a frame with `text` and `TEXT` can't be asked for either.
    Renaming by position first makes any extra or clashing column harmless. Of columns with exactly
    the same name the first counts.
    """
    columns = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(columns))])
    wanted = {name: name for name in names} | renamed
    return plain.select(*[F.col(f"c{columns.index(source)}").alias(name) for name, source in wanted.items()])


class Carried:
    """A frame whose columns are renamed by position while an operator works, and named back after it."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.types = df.schema
        self.slots = [f"c{i}" for i in range(len(self.names))]
        self.df = df.toDF(*self.slots)

    def slot(self, name: str) -> str:
        return self.slots[self.names.index(name)]

    def col(self, name: str) -> Column:
        return F.col(self.slot(name))

    def back(self, df: DataFrame) -> DataFrame:
        return df.select(*self.slots).toDF(*self.names)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once per row, however often `use` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """The words of a whole text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def row_key(doc_id: Column, text: Column) -> Column:
    """64 bits that tell rows apart where ids are null or repeated; rows equal in both count as one document."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")), text.isNull())


def running_sum(numbers: Column, block: int = 128) -> Column:
    """Running sums of an array of longs, built block by block so that long arrays aren't copied for every item."""

    def add(state: Column, item: Column) -> Column:
        return F.struct((state["total"] + item).alias("total"), F.concat(state["sums"], F.array(state["total"] + item)).alias("sums"))

    empty = F.array().cast("array<bigint>")

    def add_block(state: Column, start: Column) -> Column:
        part = F.aggregate(
            F.slice(numbers, start + 1, F.lit(block)), F.struct(state["total"].alias("total"), empty.alias("sums")), add
        )
        return let(part, lambda p: F.struct(p["total"].alias("total"), F.concat(state["sums"], p["sums"]).alias("sums")))

    starts = F.when(F.size(numbers) > 0, F.sequence(F.lit(0), F.size(numbers) - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(starts, F.struct(F.lit(0).cast("bigint").alias("total"), empty.alias("sums")), add_block, lambda s: s["sums"])
