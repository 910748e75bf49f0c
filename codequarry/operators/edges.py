"""Joins over stored facts: calls with their files and callers, references, one-hop traces, dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.operators.lookup import containing, containing_in
from codequarry.operators.topk import top_k
from codequarry.session import cut


def calls_with_context(calls: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every call with its file's facts and, where known, its caller's name."""
    callers = symbols.select(F.col("symbol_id").alias("caller_symbol_id"), F.col("name").alias("caller_name"))
    return calls.join(files, "file_id").join(callers, "caller_symbol_id", "left")


def references_to(targets: DataFrame, calls: DataFrame, symbols: DataFrame, limit: int) -> DataFrame:
    """targets(target_symbol_id) to their first `limit` call sites by path and line."""
    callers = symbols.select(F.col("symbol_id").alias("caller_symbol_id"), F.col("name").alias("caller_name"))
    known = calls.filter("target_symbol_id IS NOT NULL").join(targets, "target_symbol_id", "left_semi")
    order = [F.col("path"), F.col("start_line"), F.col("call_id")]
    return top_k(known, ["target_symbol_id"], order, limit).join(callers, "caller_symbol_id", "left")


def trace(requests: DataFrame, calls: DataFrame, symbols: DataFrame, direction: str, limit: int) -> DataFrame:
    """requests(request_id, symbol_id) to direct callers or callees with status and confidence.

    A neighbour reached with two confidences appears twice. Only edges at an asked symbol are made
    distinct, and that before the join, so many calls of one pair travel as one row.
    """
    anchor, other = (
        ("target_symbol_id", "caller_symbol_id") if direction == "callers" else ("caller_symbol_id", "target_symbol_id")
    )
    asked = requests.withColumnRenamed("symbol_id", "_anchor")
    edges = calls.filter(F.col(anchor).isNotNull() & F.col(other).isNotNull()).select(
        F.col(anchor).alias("_anchor"), F.col(other).alias("symbol_id"), "resolution_status", "confidence"
    ).join(asked.select("_anchor").distinct(), "_anchor", "left_semi").distinct()
    found = asked.join(edges, "_anchor").join(symbols, "symbol_id")
    order = [F.col("confidence").desc(), F.col("path"), F.col("start_line"), F.col("symbol_id")]
    return top_k(found, ["request_id"], order, limit).drop("_anchor")


def search_symbols(requests: DataFrame, symbols: DataFrame, limit: int, grams: DataFrame | None = None) -> DataFrame:
    """requests(request_id, project_id, needle, current_file): exact, then prefix, then substring matches.

    grams(gram, word) are the stored grams of the folded names; without them the names' are exploded.

    Needles meet the distinct names, not the symbols; each name then offers its first rows of the
    project and its first rows in the current file, which together hold all the ranking can pick.
    """
    asked = requests.select("request_id", "project_id", "current_file", tx.ascii_lower(F.trim("needle")).alias("needle")).filter(
        "needle <> ''"
    )
    named = symbols.withColumn("low", tx.ascii_lower(F.col("name")))
    needles = asked.select("needle").distinct()
    if grams is None:
        pairs = containing(needles, named.select("low").distinct(), "needle", "low")
    else:
        pairs = containing_in(cut(needles), grams.withColumnRenamed("word", "low"), "needle", "low")
    rating = F.when(F.col("low") == F.col("needle"), 0).when(F.startswith("low", "needle"), 1).otherwise(2)
    rated = cut(pairs.withColumn("_class", rating))
    by_id = [F.col("symbol_id")]
    hit = named.join(rated.select("low").distinct(), "low", "left_semi").join(asked.select("project_id").distinct(), "project_id", "left_semi")
    # Ranking: class, file, length, id. Without the file it is one list per project and needle, so
    # that list is cut first; the file hits are found separately.
    anywhere = top_k(hit, ["project_id", "low"], by_id, limit, "_n").drop("_n").join(rated, "low")
    heads = top_k(
        anywhere, ["project_id", "needle", "_class"], [F.length("name"), F.col("symbol_id")], limit, "_n"
    ).drop("_n")
    elsewhere = F.coalesce(F.col("path") != F.col("current_file"), F.lit(True))
    far = asked.join(heads, ["project_id", "needle"]).filter(elsewhere)
    local = top_k(hit, ["project_id", "path", "low"], by_id, limit, "_n").drop("_n").withColumnRenamed("path", "current_file")
    # A file's names are far fewer than those that hold a needle of one letter.
    near = asked.join(local, ["project_id", "current_file"]).join(rated, ["needle", "low"]).withColumn("path", F.col("current_file"))
    # Heads of one class may all lie in the current file, so far hits get as many more as that hides.
    both = far.withColumn("_near", F.lit(1)).unionByName(near.withColumn("_near", F.lit(0)))
    order = [F.col("_class"), F.col("_near"), F.length("name"), F.col("symbol_id")]
    return top_k(both, ["request_id"], order, limit).withColumn(
        "score", F.when(F.col("_class") == 0, 1.0).otherwise(0.8) - F.col("rank") * 0.001
    ).withColumn("match", F.when(F.col("_class") == 0, "exact").otherwise("fuzzy")).drop("_class", "_near", "low")


def dependency_edges(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """imports([project_id,] src, module) and modules([project_id,] module, dst) to distinct file-to-file edges.

    With project_id on both sides a module name only means the file of its own project.
    """
    scope = ["project_id"] if "project_id" in imports.columns and "project_id" in modules.columns else []
    return imports.select(*scope, "src", "module").distinct().join(modules, [*scope, "module"]).filter("src <> dst").select(
        *scope, "src", "dst"
    ).distinct()


def reverse_references(calls: DataFrame) -> DataFrame:
    """Callers of each target, once each, with the number of call sites. Rows, never one long list."""
    known = calls.filter("target_symbol_id IS NOT NULL AND caller_symbol_id IS NOT NULL")
    return known.filter("target_symbol_id <> caller_symbol_id").groupBy("target_symbol_id", "caller_symbol_id").agg(
        F.count("*").alias("sites")
    )


def central_modules(files: DataFrame, edges: DataFrame, per_project: int = 8) -> DataFrame:
    """Most imported files per project: inbound, symbols, dependencies, path; no package markers.

    files needs project_id, path, symbols (a count); edges need project_id where paths repeat
    across projects, and join by path alone where they have none.
    """
    key = ["project_id", "path"] if "project_id" in edges.columns else ["path"]
    scope = key[:-1]
    inbound = edges.groupBy(*scope, F.col("dst").alias("path")).agg(F.count("*").alias("inbound"))
    outbound = edges.groupBy(*scope, F.col("src").alias("path")).agg(F.count("*").alias("dependencies"))
    rated = files.filter(~F.col("path").rlike(r"(^|/)__init__\.py$")).join(inbound, key, "left").join(
        outbound, key, "left"
    ).na.fill(0, ["inbound", "dependencies"])
    order: list[Column] = [
        F.col("inbound").desc(), F.col("symbols").desc(), F.col("dependencies").desc(), F.lower("path"), F.col("path")
    ]
    return top_k(rated, ["project_id"], order, per_project)
