"""Reading source trees: a distributed walk, ignore rules, and a decoding reader.

The walk lists one directory level per round, with the directories of a level spread over the
cluster; file bodies are read in a second stage spread by path, so one huge directory does not
become one huge task. Spark's own file listing is not used because it hides names starting with `_`
or `.`, such as `__init__.py`. Roots must be visible to all executors.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import paths as px
from codequarry.options import DEFAULTS, Options
from codequarry.session import cut

ENCODINGS = ("utf-8-sig", "utf-8", "gb18030")
SNIFF_BYTES = 8192
_LISTING = "project_id string, root string, path string, is_dir boolean, size bigint, mtime_ns bigint, problem string"
_BODY = "project_id string, root string, path string, size bigint, mtime_ns bigint, language string, content string, source_hash string, problem string"


def decode(data: bytes) -> str | None:
    """Text of a file, or None for binary data."""
    if b"\x00" in data[:SNIFF_BYTES]:
        return None
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="replace")


def _listed(rows: list[tuple]) -> pd.DataFrame:
    """Rows of a listing; sizes and times stay whole numbers beside those of directories, which have none."""
    columns = ["project_id", "root", "path", "is_dir", "size", "mtime_ns", "problem"]
    return pd.DataFrame(rows, columns=columns, dtype=object).astype({"size": "Int64", "mtime_ns": "Int64"})


def _list_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for project, root, path in zip(batch["project_id"], batch["root"], batch["path"]):
            rows = []
            try:
                with os.scandir(os.path.join(root, path)) as entries:
                    for entry in entries:
                        inner = f"{path}/{entry.name}" if path else entry.name
                        if entry.is_dir(follow_symlinks=False):
                            if entry.name not in px.SKIPPED_DIRS:
                                rows.append((project, root, inner, True, None, None, None))
                        elif entry.is_file():
                            stat = entry.stat()
                            rows.append((project, root, inner, False, stat.st_size, stat.st_mtime_ns, None))
                        if len(rows) >= 10_000:
                            yield _listed(rows)
                            rows = []
            except OSError as exc:
                rows.append((project, root, path, False, None, None, type(exc).__name__))
            if rows:
                yield _listed(rows)


def list_tree(spark: SparkSession, roots: DataFrame) -> DataFrame:
    """roots(project_id, root) to every file below them, hard-skipped directories left out."""
    level = roots.select("project_id", "root", F.lit("").alias("path"))
    found = None
    while True:
        width = spark.sparkContext.defaultParallelism
        listed = cut(level.repartition(width, "root", "path").mapInPandas(_list_level, _LISTING))
        files = listed.filter("NOT is_dir").drop("is_dir")
        found = files if found is None else found.unionByName(files)
        level = listed.filter("is_dir").select("project_id", "root", "path")
        if level.isEmpty():
            return found


def _read_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("project_id", pa.string()), ("root", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()),
        ("language", pa.string()), ("content", pa.string()), ("source_hash", pa.string()), ("problem", pa.string()),
    ])
    for batch in batches:
        out, held = [], 0
        for row in batch.to_pylist():
            try:
                with open(os.path.join(row["root"], row["path"]), "rb") as handle:
                    data = handle.read()
                text = decode(data)
                row |= {"content": text, "source_hash": hashlib.sha256(data).hexdigest(), "problem": None if text is not None else "binary"}
            except OSError as exc:
                row |= {"content": None, "source_hash": None, "problem": type(exc).__name__}
            out.append(row)
            held += row["size"] or 0
            if held > 32_000_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def ignore_rules(listing: DataFrame, names: tuple[str, ...] = (".gitignore",)) -> DataFrame:
    """Ordered rules per root, from its ignore files. These are read whatever their size: a rule left out lets files in."""
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("path"))
    files = listing.filter(F.col("path").isin(*names))
    texts = files.select("project_id", "root", "path", "size", "mtime_ns", F.lit(None).cast("string").alias("language")).mapInArrow(_read_bodies, _BODY)
    lines = texts.select("root", order.alias("file_no"), F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line"))
    rules = lines.select("root", "file_no", "line_no", px.parse_ignore_rule(F.col("line")).alias("rule")).filter("rule IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("file_no", "line_no", "rule")))
    return rules.groupBy("root").agg(F.transform(ordered, lambda r: r["rule"]).alias("rules"))


def scan_tree(
    spark: SparkSession, roots: DataFrame, options: Options = DEFAULTS, ignore_names: tuple[str, ...] = (".gitignore",)
) -> DataFrame:
    """roots(project_id, root) to files with language, text and hash; `problem` marks skipped ones."""
    listing = list_tree(spark, roots)
    with_rules = listing.join(ignore_rules(listing, ignore_names), "root", "left")
    wanted = with_rules.withColumn("language", px.language(F.col("path"))).filter("language IS NOT NULL")
    kept = wanted.filter(F.col("rules").isNull() | ~px.is_ignored(F.col("path"), F.col("rules"))).drop("rules")
    readable = F.col("problem").isNull() & (F.col("size") <= options.max_file_bytes)
    width = spark.sparkContext.defaultParallelism
    bodies = kept.filter(readable).select("project_id", "root", "path", "size", "mtime_ns", "language").repartition(
        width, "root", "path"
    ).mapInArrow(_read_bodies, _BODY)
    skipped = kept.filter(~readable).select(
        "project_id", "root", "path", "size", "mtime_ns", "language", F.lit(None).cast("string").alias("content"),
        F.lit(None).cast("string").alias("source_hash"), F.coalesce("problem", F.lit("too_large")).alias("problem"),
    )
    return bodies.unionByName(skipped)
