"""How the driver tables become the corpora the operators work on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.session import cut
from codequarry.sources.tables import load, spread

# A line number never reaches this: documents hold at most 20,000 words.
LINE_STRIDE = 1_000_000


def files(spark: SparkSession, sf: str, even: bool = True) -> DataFrame:
    """documents as indexed files: project, path, content, hash, size. even: dealt to every core, for jobs that don't shuffle them anyway."""
    docs = load(spark, sf, "documents")
    docs = spread(docs, "doc_id") if even else docs
    return docs.select(
        F.col("source").alias("project_id"),
        F.col("doc_id").alias("file_id"),
        F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt"))).alias("path"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
        F.sha2("text", 256).alias("source_hash"),
        F.octet_length("text").cast("long").alias("size"),
    )


SQL_FILES = """files AS (
  SELECT source AS project_id, doc_id AS file_id,
         source || '/' || lang || '/doc_' || doc_id || '.txt' AS path,
         lang AS language, text AS content, sha256(text) AS source_hash, strlen(text) AS size
  FROM documents)"""


def file_lines(spark: SparkSession, sf: str, even: bool = True) -> DataFrame:
    """files plus the array of lines and its length."""
    with_lines = files(spark, sf, even).withColumn("lines", tx.lines_of(F.col("content")))
    return with_lines.withColumn("line_count", F.size("lines"))


SQL_BREAK = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'"


def sql_lines(text: str) -> str:
    """SQL for splitlines() of an expression."""
    pieces = f"string_split_regex({text}, {SQL_BREAK})"
    return f"(CASE WHEN {pieces}[-1] = '' THEN {pieces}[:-2] ELSE {pieces} END)"


SQL_LINED = f"""{SQL_FILES},
lined AS (SELECT *, len(lines) AS line_count
          FROM (SELECT *, {sql_lines('content')} AS lines FROM files))"""


def line_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per line of every document."""
    return file_lines(spark, sf).select(
        "project_id", "file_id", "path", "language", "source_hash",
        F.posexplode("lines").alias("pos", "line"),
    ).withColumn("line_no", F.col("pos") + 1).drop("pos")


SQL_LINE_ROWS = f"""{SQL_LINED},
line_rows AS (SELECT project_id, file_id, path, language, source_hash, line, line_no
  FROM (SELECT project_id, file_id, path, language, source_hash,
               unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM lined))"""


def outline_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of the document corpus: the leading word of each line, spanning that line."""
    rows = line_rows(spark, sf)
    name = F.regexp_extract("line", "^[A-Za-z_][A-Za-z0-9_]*", 0)
    return rows.withColumn("name", name).filter("name <> ''").select(
        (F.col("file_id") * LINE_STRIDE + F.col("line_no")).alias("symbol_id"),
        "project_id", "file_id", "path", "language", "source_hash", "name",
        F.when(F.col("name").rlike("^[A-Z]"), F.lit("class")).otherwise(F.lit("function")).alias("kind"),
        F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"),
        F.col("line").alias("content"),
    )


def outline_calls(spark: SparkSession, sf: str, symbols: DataFrame | None = None) -> DataFrame:
    """Calls of the document corpus: each line calls its second word.

    The target is set when exactly one symbol of the project carries that name, else the call is ambiguous or
    unresolved. The count per name is aggregated first, so a frequent name never fans out.
    """
    rows = line_rows(spark, sf)
    symbols = outline_symbols(spark, sf) if symbols is None else symbols
    words = F.regexp_extract_all("line", F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0)
    calls = rows.withColumn("callee_name", F.try_element_at(words, F.lit(2))).filter("callee_name IS NOT NULL")
    calls = calls.select(
        (F.col("file_id") * LINE_STRIDE + F.col("line_no")).alias("call_id"),
        "project_id", "file_id", "path", "language", "source_hash", "callee_name",
        F.lower("callee_name").alias("name_key"),
        F.when(
            F.regexp_extract("line", "^[A-Za-z_][A-Za-z0-9_]*", 0) != "",
            F.col("file_id") * LINE_STRIDE + F.col("line_no"),
        ).alias("caller_symbol_id"),
        F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"),
        F.col("line").alias("content"),
    )
    by_name = symbols.groupBy("project_id", F.lower("name").alias("name_key")).agg(
        F.count("*").alias("n"), F.min("symbol_id").alias("only_id")
    )
    resolved = calls.join(by_name, ["project_id", "name_key"], "left")
    return resolved.select(
        *[c for c in calls.columns if c != "name_key"],
        F.when(F.col("n") == 1, F.col("only_id")).alias("target_symbol_id"),
        F.when(F.col("n") == 1, F.lit("resolved")).when(F.col("n") > 1, F.lit("ambiguous"))
        .otherwise(F.lit("unresolved")).alias("resolution_status"),
        F.when(F.col("n") == 1, F.lit(0.45)).otherwise(F.lit(0.0)).alias("confidence"),
    )


def stored_outline(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and calls written once, for jobs that read them several times."""
    symbols = cut(outline_symbols(spark, sf))
    return symbols, cut(outline_calls(spark, sf, symbols))


SQL_OUTLINE = f"""{SQL_LINE_ROWS},
symbols AS (
  SELECT file_id * {LINE_STRIDE} + line_no AS symbol_id, project_id, file_id, path, language,
         source_hash, name, CASE WHEN regexp_matches(name, '^[A-Z]') THEN 'class' ELSE 'function' END AS kind,
         line_no AS start_line, line_no AS end_line, line AS content
  FROM (SELECT *, regexp_extract(line, '^[A-Za-z_][A-Za-z0-9_]*') AS name FROM line_rows)
  WHERE name <> ''),
name_counts AS (SELECT project_id, lower(name) AS k, count(*) AS n, min(symbol_id) AS only_id FROM symbols GROUP BY ALL),
calls AS (
  SELECT c.call_id, c.project_id, c.file_id, c.path, c.language, c.source_hash, c.callee_name,
         c.caller_symbol_id, c.start_line, c.end_line, c.content,
         CASE WHEN n = 1 THEN only_id END AS target_symbol_id,
         CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution_status,
         CASE WHEN n = 1 THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END AS confidence
  FROM (SELECT file_id * {LINE_STRIDE} + line_no AS call_id, project_id, file_id, path, language,
               source_hash, regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*')[2] AS callee_name,
               CASE WHEN regexp_extract(line, '^[A-Za-z_][A-Za-z0-9_]*') <> ''
                    THEN file_id * {LINE_STRIDE} + line_no END AS caller_symbol_id,
               line_no AS start_line, line_no AS end_line, line AS content FROM line_rows) c
  LEFT JOIN name_counts n ON n.k = lower(c.callee_name) AND n.project_id = c.project_id
  WHERE c.callee_name IS NOT NULL)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """benchmark items as free-text requests; the document of the same number is open and names the project."""
    opened = files(spark, sf, even=False).select(
        F.col("file_id").alias("request_id"), F.col("project_id").alias("open_project"), F.col("path").alias("current_file")
    )
    items = load(spark, sf, "benchmark").select(F.col("item_id").alias("request_id"), F.col("text").alias("question"))
    return items.join(opened, "request_id", "left").select(
        "request_id", F.coalesce("open_project", F.lit(NO_PROJECT)).alias("project_id"), "question", "current_file"
    )


# Requests without an open document ask this project.
NO_PROJECT = "src0"

SQL_REQUESTS = f"""requests AS (SELECT item_id AS request_id, coalesce(d.source, '{NO_PROJECT}') AS project_id, b.text AS question,
  d.source || '/' || d.lang || '/doc_' || d.doc_id || '.txt' AS current_file FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id)"""
