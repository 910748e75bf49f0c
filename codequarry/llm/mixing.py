"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A source whose target is f times its own size takes
floor(f) whole copies of each document for certain; the rest of the target is filled by Pareto order
sampling: with the document's uniform number u and its inclusion odds o, documents are taken in the
order of (u / (1 - u)) / o. Odds differ between sources (their remaining share) and between documents
(a document as large as the whole rest has half the odds of a small one). The cut is where the words
taken come closest to the rest, so the sample's size is fixed in words, not left to chance.

u comes from a digest of the document's id and text, so reruns agree on any cluster.

A source may hold most rows: its order isn't sorted in one task. Ranks are counted in 4096 equal
steps per source first, a running sum over the steps finds the one that holds the cut, and only that
step's documents are ordered. Columns stay in the JVM throughout.

Defined results: a null text has size 0 and takes 0 words; a null source is a source of its own,
named last; sources without words have target 0; equal rows (id, text and source) share one place in
the order and are taken together; an empty table gives an empty result.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import WORD, Carried, pick
from codequarry.session import cut

#: Relative weights of the sources by code point, repeated as often as needed.
WEIGHTS = (5, 2, 1)
#: A source is repeated this often at most.
MOST_COPIES = 3
STEPS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources whose cap most * size / weight lies below the common level are capped; the level is what
    remains for the others by weight. Sorted by that cap, one running sum finds it exactly, without
    rounds of resharing. The table has one row per source, however many documents there are.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = totals.withColumn("weight", weight)
    # Caps compare as whole numbers: size / weight times the product of the weights.
    scale = prod(weights)
    parts = F.create_map(*[F.lit(x).cast("bigint") for w in dict.fromkeys(weights) for x in (w, scale // w)])
    place = F.col("source_size") * parts[F.col("weight")]
    ordered = Window.orderBy(place, F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = weighed.select(
        "source", "source_size", "weight",
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
        F.sum("source_size").over(everything).alias("total"),
    )
    # Level if all sources before this one are capped; a source is capped while its own cap lies below that.
    level = (F.col("total") - F.lit(most) * F.col("size_before")) / F.col("weight_left")
    capped = F.lit(most) * F.col("source_size") <= level * F.col("weight")
    levelled = ranked.withColumn("level", level).withColumn("capped", capped)
    shared = F.min(F.when(~F.col("capped"), F.struct("size_before", "level"))).over(everything)["level"]
    target = F.when(F.col("capped"), (F.lit(most) * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("shared"))
    return levelled.withColumn("shared", shared).select("source", "source_size", target.cast("double").alias("target"))


def uniform(doc_id: Column, text_digest: Column, seed: str) -> Column:
    """A number in (0, 1) with 52 random bits from the document's id and the digest of its text."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), text_digest))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_limits(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: target, whole copies, rest, and the place in the Pareto order up to which the rest reaches."""
    targets = cut(source_targets(sized, weights, most))
    placed = _placed(sized, _shares(targets)).filter("ratio is not null")
    steps = placed.groupBy("key", "step").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    over = Window.partitionBy("key").orderBy("step")
    summed = steps.withColumn("before", F.sum("words").over(over) - F.col("words"))
    # The step in which the running sum reaches the rest; it exists, as the rest is below the source's size.
    cuts = summed.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    cuts = cut(cuts.select("key", F.col("step").alias("cut_step"), F.col("before").alias("cut_before")))
    inside = placed.join(cuts, "key").filter("step = cut_step")
    # Equal rows are one place in the order, so a run of copies doesn't make the order ambiguous.
    places = inside.groupBy("key", "ratio", "tie").agg(
        F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("cut_before").alias("cut_before")
    )
    order = Window.partitionBy("key").orderBy("ratio", "tie")
    running = places.withColumn("upto", F.col("cut_before") + F.sum("words").over(order))
    # The closest prefix: a place is in if half of it or more lies within the rest.
    last = running.filter(F.col("upto") * 2 - F.col("words") <= F.col("rest") * 2).groupBy("key").agg(F.max(F.struct("ratio", "tie")).alias("last_in"))
    return cut(_shares(targets).join(cuts.drop("cut_before"), "key", "left").join(last, "key", "left"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def _shares(targets: DataFrame) -> DataFrame:
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    shares = targets.withColumn("whole", F.floor(factor)).withColumn("rest", rest).withColumn("share", F.try_divide("rest", "source_size"))
    return shares.select(_key(F.col("source")).alias("key"), "source_size", "target", "whole", "rest", "share")


def _placed(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """Rows with their source's figures, their ratio in the Pareto order and its step."""
    # Nothing to fill, or a rest that rounding made a whole copy: no odds and no place in the order.
    odds = F.try_divide(F.try_divide(F.col("share"), F.lit(1.0) - F.col("share")), F.lit(1.0) + F.try_divide(F.col("size"), F.col("rest")))
    ratio = F.try_divide(F.col("u") / (F.lit(1.0) - F.col("u")), odds)
    # Documents without words take nothing whatever their place, so they need none.
    joined = sized.withColumn("key", _key(F.col("source"))).join(shares, "key")
    placed = joined.withColumn("ratio", F.when((F.col("rest") > 0) & (F.col("size") > 0), ratio))
    return placed.withColumn("step", F.floor(F.col("ratio") / (F.lit(1.0) + F.col("ratio")) * F.lit(STEPS)).cast("int"))


def _copies(sized: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds `copies`, the times a row is taken, by its source's limits."""
    within = (F.col("step") < F.col("cut_step")) | (
        (F.col("step") == F.col("cut_step")) & F.coalesce(F.struct("ratio", "tie") <= F.col("last_in"), F.lit(False))
    )
    extra = F.when(F.col("ratio").isNotNull() & F.coalesce(within, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    return _placed(sized, limits).withColumn("copies", (F.col("whole") + extra).cast("int"))


def _sized(df: DataFrame, carry: list[str], doc_id: Column, text: Column, source: Column, seed: str) -> DataFrame:
    digest = F.md5(F.coalesce(text, F.lit("")))
    return df.select(
        *carry, source.alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        uniform(doc_id, digest, seed).alias("u"), F.struct(F.coalesce(doc_id.cast("string"), F.lit("null")).alias("id"), digest.alias("digest")).alias("tie"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (words, repeats counted) of every row."""
    plain = pick(docs, "doc_id", "text", "source")
    sized = cut(_sized(plain, ["doc_id"], F.col("doc_id"), F.col("text"), F.col("source"), seed))
    taken = _copies(sized, source_limits(sized, weights, most))
    return taken.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def materialise(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """The mixed corpus itself: every row as often as the mix takes it, with all its columns.

    The limits come from a table of sizes; the texts are then read once more and never shuffled.
    """
    plain = pick(docs, "doc_id", "text", "source")
    limits = source_limits(cut(_sized(plain, [], F.col("doc_id"), F.col("text"), F.col("source"), seed)), weights, most)
    frame = Carried(docs)
    sized = _sized(frame.df, frame.slots, frame.col("doc_id"), frame.col("text"), frame.col("source"), seed)
    repeated = _copies(sized, limits).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return frame.back(repeated)
