"""Line-addressed pieces of a file: overlapping chunks, generic segments, gap filling, skeletons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.options import DEFAULTS, Options

# Generic segments close at a blank line from 50 lines on, and at 90 lines anyway.
GENERIC_TARGET = 50
GENERIC_MAX = 90


def chunk_starts(line_count: Column, options: Options = DEFAULTS) -> Column:
    """Zero-based first lines of the chunks of a non-empty file."""
    step = options.chunk_lines - options.chunk_overlap
    last = F.greatest(line_count - options.chunk_overlap - 1, F.lit(0))
    return F.when(line_count > 0, F.sequence(F.lit(0), last, F.lit(step)))


def text_chunks(files: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """files(file_id, lines, line_count, ...) to overlapping chunks. No shuffle."""
    kept = [c for c in files.columns if c not in ("lines", "line_count", "content", "size")]
    pieces = files.withColumn("_start", F.explode(chunk_starts(F.col("line_count"), options)))
    content = tx.join_lines(F.slice("lines", F.col("_start") + 1, options.chunk_lines))
    return pieces.select(
        *kept,
        (F.col("_start") + 1).alias("start_line"),
        F.least(F.col("_start") + options.chunk_lines, F.col("line_count")).alias("end_line"),
        content.alias("content"),
    ).withColumn("content_hash", F.sha2("content", 256))


def generic_cuts(lines: Column) -> Column:
    """Last line (1-based) of every generic segment, as one fold over the blank-line flags."""
    blank = F.transform(lines, lambda line: tx.is_blank(line))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))

    def step(state: Column, is_blank: Column) -> Column:
        run, at = state["run"] + 1, state["at"] + 1
        close = ((run >= GENERIC_TARGET) & is_blank) | (run >= GENERIC_MAX)
        return F.struct(
            F.when(close, F.lit(0)).otherwise(run).alias("run"),
            at.alias("at"),
            F.when(close, F.concat(state["cuts"], F.array(at))).otherwise(state["cuts"]).alias("cuts"),
        )

    def finish(state: Column) -> Column:
        return F.when(state["run"] > 0, F.concat(state["cuts"], F.array(state["at"]))).otherwise(state["cuts"])

    return F.aggregate(blank, start, step, finish)


def generic_segments(files: DataFrame) -> DataFrame:
    """Segments of files without a structural parser. One row per segment, no shuffle."""
    cut = files.withColumn("_cuts", generic_cuts(F.col("lines")))
    rows = cut.select("*", F.posexplode("_cuts").alias("ord", "end_line"))
    start = F.when(F.col("ord") == 0, F.lit(1)).otherwise(F.try_element_at("_cuts", F.col("ord")) + 1)
    return rows.withColumn("start_line", start).drop("_cuts").withColumn("kind", F.lit("chunk")).withColumn(
        "title",
        F.concat(F.lit("第 "), "start_line", F.lit("~"), "end_line", F.lit(" 行")),
    )


def fill_gaps(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Stretch each file's segments so that together they cover every line once.

    Needs start_line, end_line and line_count. Windows run per file, whose size is capped on entry.
    """
    per_file = Window.partitionBy(*keys).orderBy("start_line", "end_line")
    before, after = F.lag("end_line").over(per_file), F.lead("end_line").over(per_file)
    return segments.select(
        *[c for c in segments.columns if c not in ("start_line", "end_line")],
        F.when(before.isNull(), F.lit(1))
        .when(F.col("start_line") > before + 1, before + 1)
        .otherwise(F.col("start_line"))
        .alias("start_line"),
        F.when(after.isNull(), F.greatest("end_line", "line_count")).otherwise(F.col("end_line")).alias("end_line"),
        (F.row_number().over(per_file) - 1).alias("segment_no"),
    )


def skeleton_part(kind: Column, lines: Column) -> Column:
    """One segment's share of a skeleton: 40 lines of prose-like kinds, else a two-line head."""
    size = F.size(lines)
    long_note = F.when(size > 40, F.array(F.lit("# …"))).otherwise(F.array().cast("array<string>"))
    whole = tx.join_lines(F.concat(F.slice(lines, 1, 40), long_note))
    head = F.concat(
        tx.join_lines(F.slice(lines, 1, 2)),
        F.lit("\n    # …（共 "), size.cast("string"), F.lit(" 行，实现省略）"),
    )
    return F.when(kind.isin("docstring", "imports", "globals"), whole).otherwise(head)


def imports_summary(lines: Column, max_lines: int = 30) -> Column:
    """Non-blank import lines, shortened to `max_lines`."""
    kept = F.filter(lines, lambda line: ~tx.is_blank(line))
    note = F.when(F.size(kept) > max_lines, F.array(F.lit("# …（更多导入省略）"))).otherwise(
        F.array().cast("array<string>")
    )
    return tx.join_lines(F.concat(F.slice(kept, 1, max_lines), note))
