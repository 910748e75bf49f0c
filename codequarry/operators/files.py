"""File-level operators: listings, directory children, spans, previews, fingerprints, path search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import paths as px
from codequarry.functions import text as tx
from codequarry.operators.lookup import containing
from codequarry.operators.topk import top_k
from codequarry.options import DEFAULTS, Options


def list_files(files: DataFrame, glob: Column) -> DataFrame:
    return files.filter(F.regexp_like("path", px.glob_regex(glob))).orderBy("project_id", F.lower("path"), "path")


def directory_children(files: DataFrame) -> DataFrame:
    """Children of every directory prefix: name, is_dir, is_code; hidden directories left out.

    Each path offers one row per ancestor; the aggregate combines before the shuffle, so a
    directory with very many files does not become one long list.
    """
    parts = F.split("path", "/")
    levels = files.select(
        "project_id", parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("depth")
    )
    rows = levels.select(
        "project_id",
        F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("prefix"),
        F.try_element_at("parts", F.col("depth") + 1).alias("name"),
        (F.col("depth") < F.size("parts") - 1).alias("is_dir"),
    )
    hidden = F.col("is_dir") & (F.col("name").isin(px.HIDDEN_DIRS) | F.col("name").startswith("."))
    children = rows.filter(~hidden).groupBy("project_id", "prefix", "name").agg(F.bool_or("is_dir").alias("is_dir"))
    return children.withColumn(
        "is_code", ~F.col("is_dir") & px.extension(F.col("name")).isin(px.CODE_EXTENSIONS)
    )


def read_span(lines: Column, size: Column, start: Column, end: Column, options: Options = DEFAULTS) -> Column:
    """struct(content, error): at most 200 lines and 64 KiB, inside the file."""
    content = tx.span_of(lines, start, end)
    error = (
        F.when(lines.isNull(), F.lit("missing_file"))
        .when((start < 1) | (end < start) | (end - start + 1 > options.span_lines), F.lit("invalid_span"))
        .when(size > options.max_file_bytes, F.lit("file_too_large"))
        .when(end > F.size(lines), F.lit("past_end"))
        .when(F.octet_length(content) > options.span_bytes, F.lit("span_too_large"))
    )
    return F.struct(F.when(error.isNull(), content).alias("content"), error.alias("error"))


def clamp_selection(start: Column, end: Column, line_count: Column, options: Options = DEFAULTS) -> Column:
    """struct(start_line, end_line) inside the file and at most 400 lines; null if empty."""
    first = F.greatest(F.lit(1), start)
    last = F.least(line_count, end)
    short = F.least(last, first + options.selection_lines - 1)
    return F.when(last >= first, F.struct(first.alias("start_line"), short.alias("end_line")))


def project_fingerprint(files: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Digest of every project's `path:hash` list, by one formula at every size.

    Paths fall into a fixed number of buckets by their hash; each bucket's sorted list is digested,
    then the project's bucket digests in order. A new file changes one bucket's digest and never
    moves another file, and no task holds a whole project. It is not a flat digest of the list.
    """
    spot = F.conv(F.substring(F.sha2("path", 256), 1, 8), 16, 10).cast("long") % options.fingerprint_buckets
    listed = F.array_sort(F.collect_list(F.struct("path", "source_hash")))
    text = F.array_join(F.transform(listed, lambda x: F.concat(x["path"], F.lit(":"), x["source_hash"])), "|")
    parts = files.withColumn("bucket", spot).groupBy("project_id", "bucket").agg(
        F.count("*").alias("files"), F.sha2(text, 256).alias("part")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "part"))), lambda x: x["part"]), "|")
    return parts.groupBy("project_id").agg(F.sum("files").alias("files"), F.sha2(joined, 256).alias("fingerprint"))


def search_paths(requests: DataFrame, files: DataFrame, limit: int, options: Options = DEFAULTS) -> DataFrame:
    """requests(request_id, project_id, needle) to matching files of the project: prefix hits first, then short paths.

    Joins needles to paths through shared n-grams; the preview is cut only for the rows kept.
    """
    asked = requests.select("request_id", "project_id", tx.ascii_lower(F.trim("needle")).alias("needle")).filter("needle <> ''")
    wanted = asked.select("project_id").distinct()
    hay = files.select("project_id", "path", tx.ascii_lower(F.col("path")).alias("low")).join(wanted, "project_id", "left_semi")
    pairs = containing(asked.select("needle").distinct(), hay.select("low").distinct(), "needle", "low")
    hits = pairs.join(hay, "low").withColumn("_late", (~F.startswith("low", "needle")).cast("int"))
    order = [F.col("_late"), F.length("path"), F.col("low"), F.col("path")]
    heads = top_k(hits, ["project_id", "needle"], order, limit)
    found = asked.join(heads, ["project_id", "needle"])
    previews = files.filter("line_count > 0").select(
        "project_id", "path", "source_hash",
        F.least("line_count", F.lit(options.file_preview_lines)).alias("end_line"),
        tx.join_lines(F.slice("lines", 1, options.file_preview_lines)).alias("content"),
    )
    return found.join(previews, ["project_id", "path"]).select(
        "request_id", "rank", "project_id", "path", "source_hash", F.lit(1).alias("start_line"), "end_line", "content",
        (0.7 - F.col("rank") * 0.001).alias("score"),
    )


def argument_problem(text: Column, required: bool, options: Options = DEFAULTS) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")))
    missing = F.when(F.lit(required) & (bare == ""), F.lit("required"))
    return F.coalesce(missing, F.when(F.length(bare) > options.argument_chars, F.lit("too_long")))


def cursor_problem(cursor: Column, options: Options = DEFAULTS) -> Column:
    """Null for an absent or valid cursor."""
    number = F.try_to_number(F.trim(cursor), F.lit("S999999999")).cast("long")
    bad = ~F.trim(cursor).rlike(r"^[+-]?\d{1,9}$") | (number < 0) | (number > options.cursor_max)
    return F.when(cursor.isNotNull() & (cursor != "") & bad, F.lit("invalid_cursor"))


def page(rows: DataFrame, keys: list[str], order: list[Column], offset: int, options: Options = DEFAULTS) -> DataFrame:
    """One page per key with total, truncated and next_cursor.

    The total is an ordinary aggregate; only offset + page_size rows per key reach the ranking.
    """
    totals = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    shown = top_k(rows, keys, order, offset + options.page_size).filter(F.col("rank") > offset)
    following = F.least(F.col("total"), F.lit(offset + options.page_size))
    return shown.join(totals, keys).withColumn("truncated", following < F.col("total")).withColumn(
        "next_cursor", F.when(following < F.col("total"), following.cast("string"))
    )
