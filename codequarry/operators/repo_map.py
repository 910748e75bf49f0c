"""The repository map: files with their imports and symbols, cut to a character budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.operators.topk import top_k

# Fixed value: the last line of a map that did not fit.
MARKER = "… repository map truncated"


def first_modules(imports: DataFrame, limit: int = 8) -> DataFrame:
    """First distinct modules of each project's file, joined in order; imports(project_id, path, module[, level]).

    Where there is a level, only imports of the module itself count, not those inside functions.
    """
    if "level" in imports.columns:
        imports = imports.filter("level = 'module'")
    key = ["project_id", "path"]
    heads = top_k(imports.select(*key, "module").distinct(), key, [F.col("module")], limit)
    return heads.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("module")), ", ").alias("modules"))


def repository_map(
    files: DataFrame, symbols: DataFrame, imports: DataFrame, max_tokens: int, current: DataFrame | None = None
) -> DataFrame:
    """Files with their symbols per project, cut before the first line over the character budget.

    Every line costs at least two characters, so only budget / 2 lines of a project can matter;
    the rest never reaches the running sum. current(project_id, path) names the open file of a
    project, which comes first.
    """
    budget = max(400, max_tokens * 4)
    heads = files.join(first_modules(imports), ["project_id", "path"], "left").select(
        "project_id", "path", F.lit(-1).alias("kind_no"), F.lit(0).alias("start_line"), F.lit(0).cast("long").alias("symbol_id"),
        F.concat("path", F.coalesce(F.concat(F.lit(" -> "), "modules"), F.lit(""))).alias("entry"),
    )
    kind_no = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "function", 1).otherwise(2)
    rows = symbols.select(
        "project_id", "path", kind_no.alias("kind_no"), "start_line", "symbol_id",
        F.concat(F.lit("  "), "kind", F.lit(" "), "qualified_name", F.lit(": "), F.trim("signature")).alias("entry"),
    )
    every = heads.unionByName(rows).withColumn("far", F.lit(1))
    if current is not None:
        opened = current.select("project_id", "path", F.lit(0).alias("near")).distinct()
        every = every.join(opened, ["project_id", "path"], "left").withColumn("far", F.coalesce("near", F.lit(1))).drop("near")
    order = [F.col("far"), F.col("path"), F.col("kind_no"), F.col("start_line"), F.col("symbol_id")]
    lines = top_k(every, ["project_id"], order, budget // 2 + 1)
    used = F.sum(F.length("entry") + 1).over(
        Window.partitionBy("project_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    )
    counted = lines.withColumn("used", used)
    shown = F.array_sort(F.collect_list(F.when(F.col("used") <= budget, F.struct("rank", "entry"))))
    cut_off = F.max("used") > budget
    texts = F.transform(shown, lambda x: x["entry"])
    return counted.groupBy("project_id").agg(
        F.array_join(
            F.concat(texts, F.when(cut_off, F.array(F.lit(MARKER))).otherwise(F.array().cast("array<string>"))), "\n"
        ).alias("map"),
    )
