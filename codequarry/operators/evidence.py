"""Evidence rows: validation, deduplication, ids, scoping, coverage verdicts and answer rows.

An evidence row has request_id, ord (its place), path, start_line, end_line, content, source_hash,
relation, symbol and score; some rules also read resolution, symbol_id and graph_origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import intents
from codequarry.functions import text as tx
from codequarry.operators.intervals import overlap_join
from codequarry.operators.topk import top_k
from codequarry.options import DEFAULTS

SPAN = ["path", "start_line", "end_line"]
GRAPH = ("reference", "caller", "callee")


def resolution_priority(resolution: Column) -> Column:
    # How far each kind of resolution is trusted.
    return (
        F.when(resolution.isin("exact", "enclosing"), 4)
        .when(resolution == "ambiguous_candidate", 3)
        .when(resolution == "anchor", 2)
        .otherwise(0)
    )


def _scope(*frames: DataFrame) -> list[str]:
    """Paths are unique within a project, so frames that both know theirs join by it as well."""
    return ["project_id"] if all("project_id" in f.columns for f in frames) else []


def validate(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Adds `valid`: current hash, span inside the file, and exactly the text on disk.

    The text of each distinct span is read once, however many rows cite it, and only files that
    are cited offer their text. Evidence of several projects carries project_id.
    """
    scope = _scope(evidence, files)
    key = [*scope, *SPAN]
    spans = evidence.select(*key).distinct()
    cited = files.select(*scope, "path", "source_hash", "lines").join(spans.select(*scope, "path").distinct(), [*scope, "path"], "left_semi")
    current = spans.join(cited, [*scope, "path"]).select(
        *key, F.col("source_hash").alias("_now"),
        F.sha2(tx.span_of(F.col("lines"), F.col("start_line"), F.col("end_line")), 256).alias("_text"),
    )
    checked = evidence.join(current, key, "left")
    same = (F.col("_now") == F.col("source_hash")) & (F.col("_text") == F.sha2("content", 256))
    return checked.withColumn("valid", F.coalesce(same, F.lit(False))).drop("_now", "_text")


def prefer_resolved(evidence: DataFrame) -> DataFrame:
    """One row per (path, span, relation): trust first, then score; it keeps the first one's place."""
    payload = [c for c in evidence.columns if c not in ("request_id", *SPAN, "relation")]
    merit = F.struct(resolution_priority(F.col("resolution")), F.col("score"), -F.col("ord"))
    return evidence.groupBy("request_id", *SPAN, "relation").agg(
        F.max_by(F.struct(*payload), merit).alias("_row"), F.min("ord").alias("slot")
    ).select("request_id", *SPAN, "relation", "_row.*", "slot")


def stable_ids(evidence: DataFrame) -> DataFrame:
    """E1, E2, .. per request by first appearance of (path, span, hash, relation, symbol)."""
    key = [*SPAN, "source_hash", "relation", "symbol"]
    first = evidence.groupBy("request_id", *key).agg(F.min("ord").alias("first_ord"))
    order = Window.partitionBy("request_id").orderBy("first_ord")
    return first.withColumn("evidence_id", F.concat(F.lit("E"), F.row_number().over(order)))


def locator(with_id: bool = True) -> Column:
    where = F.concat("path", F.lit(":"), "start_line", F.lit("-"), "end_line")
    return F.concat(where, F.lit(" ["), "evidence_id", F.lit("]")) if with_id else where


def joined(text: Column, order: Column, separator: str, where: Column | None = None) -> Column:
    """Texts of a bounded group in order, as one string; only those of rows `where` says so."""
    held = F.struct(order.alias("o"), text.alias("t"))
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(held if where is None else F.when(where, held))), lambda x: x["t"]),
        separator,
    )


def prompt_block() -> Column:
    symbol = F.when(F.coalesce("symbol", F.lit("")) != "", F.concat(F.lit(" · "), "symbol")).otherwise(F.lit(""))
    return F.concat(
        F.lit("["), "evidence_id", F.lit("] "), "path", F.lit(":"), "start_line", F.lit("-"), "end_line",
        F.lit(" · "), "relation", symbol, F.lit("\n"), "content",
    )


# Fixed value: the lead of the evidence section in a prompt.
PROMPT_HEAD = "## 可验证代码证据\n只可引用下列证据 ID；代码事实后用 [E1] 形式标注。\n\n"


def prompt_text(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("request_id").agg(
        F.concat(F.lit(PROMPT_HEAD), joined(prompt_block(), F.col("ord"), "\n\n")).alias("prompt")
    )


def stale_messages(messages: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """messages(message_id, anchors ARRAY<STRUCT path, source_hash>) to (fresh, stale ids).

    Messages of several projects carry project_id. A message is stale if any anchor's file is gone or has another hash; an empty hash only asks
    for the file.
    """
    scope = _scope(messages, files)
    anchors = messages.select("message_id", *scope, F.explode("anchors").alias("a")).select(
        "message_id", *scope, F.col("a.path").alias("path"), F.col("a.source_hash").alias("_hash")
    )
    known = anchors.join(files.select(*scope, "path", "source_hash"), [*scope, "path"], "left")
    bad = F.col("source_hash").isNull() | ((F.col("_hash") != "") & (F.col("_hash") != F.col("source_hash")))
    stale = known.filter(bad).select("message_id").distinct()
    return messages.join(stale, "message_id", "left_anti"), stale


def restrict_scope(retrieved: DataFrame, resolved_paths: DataFrame) -> DataFrame:
    """Where more than one path is resolved, keep those paths, graph rows and resolved references."""
    paths = resolved_paths.select("request_id", "path").distinct()
    many = paths.groupBy("request_id").agg(F.count("*").alias("_paths")).filter("_paths > 1")
    marked = retrieved.join(many, "request_id", "left").join(
        paths.withColumn("_known", F.lit(True)), ["request_id", "path"], "left"
    )
    keep = (
        F.col("_paths").isNull() | F.col("_known") | F.col("relation").isin("caller", "callee")
        | ((F.col("relation") == "reference") & (F.col("resolution_status") == "resolved"))
    )
    return marked.filter(F.coalesce(keep, F.lit(False))).drop("_paths", "_known")


def focus_on_targets(evidence: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of the target symbols and the callees found from them; all rows where none is left."""
    ids = targets.select("request_id", "symbol_id").distinct().withColumn("_target", F.lit(True))
    marked = evidence.join(ids, ["request_id", "symbol_id"], "left")
    origins = marked.filter("_target AND symbol IS NOT NULL").select(
        "request_id", F.col("symbol").alias("graph_origin")
    ).distinct().withColumn("_origin", F.lit(True))
    rated = marked.join(origins, ["request_id", "graph_origin"], "left").withColumn(
        "_focus", F.coalesce("_target", F.lit(False)) | (F.coalesce("_origin", F.lit(False)) & (F.col("relation") == "callee"))
    )
    any_focus = rated.groupBy("request_id").agg(F.bool_or("_focus").alias("_any"))
    return rated.join(any_focus, "request_id").filter(F.col("_focus") | ~F.col("_any")).drop(
        "_target", "_origin", "_focus", "_any"
    )


def target_lines(evidence: DataFrame, targets: DataFrame) -> DataFrame:
    """Sorted distinct locators of the exact targets, or of the enclosing symbols if there are none."""
    ids = targets.select("request_id", "symbol_id").distinct().withColumn("_target", F.lit(True))
    symbol = F.when(F.col("symbol").isNotNull(), F.concat(F.lit(" ("), "symbol", F.lit(")"))).otherwise(F.lit(""))
    rows = evidence.join(ids, ["request_id", "symbol_id"], "left").select(
        "request_id", F.concat(F.lit("- "), locator(False), symbol).alias("entry"),
        (F.coalesce("_target", F.lit(False)) & F.col("resolution").isin("exact", "enclosing")).alias("exact"),
        (F.col("resolution") == "enclosing").alias("around"),
    ).filter("exact OR around").groupBy("request_id", "entry").agg(
        F.bool_or("exact").alias("exact"), F.bool_or("around").alias("around")
    )
    best = rows.groupBy("request_id").agg(F.bool_or("exact").alias("_any"))
    return rows.join(best, "request_id").filter(F.col("exact") | (~F.col("_any") & F.col("around"))).groupBy(
        "request_id"
    ).agg(F.array_join(F.array_sort(F.collect_list("entry")), "\n").alias("target_note"))


def evidence_for_segments(segments: DataFrame, evidence: DataFrame, limit: int = DEFAULTS.segment_evidence) -> DataFrame:
    """segments(request_id, path, segment_id, start_line, end_line, code) to their evidence.

    Rows overlapping the segment or naming one of its identifiers come first, in evidence order,
    then definitions, callers and callees of the request. The latter are cut before they are joined.
    """
    keys = ["request_id", "segment_id"]
    left = segments.select(*keys, "path", F.col("start_line").alias("left_start"), F.col("end_line").alias("left_end"))
    right = evidence.select("request_id", "path", "ord", F.col("start_line").alias("right_start"), F.col("end_line").alias("right_end"))
    overlapping = overlap_join(left, right, ["request_id", "path"]).select(*keys, "ord", F.lit(0).alias("tier"))
    used = segments.select(*keys, F.explode(F.array_distinct(tx.identifiers(F.col("code")))).alias("symbol"))
    named = used.join(evidence.select("request_id", "symbol", "ord"), ["request_id", "symbol"]).select(
        *keys, "ord", F.lit(0).alias("tier")
    )
    spare = top_k(
        evidence.filter(F.col("relation").isin("definition", "caller", "callee")).select("request_id", "ord"),
        ["request_id"], [F.col("ord")], limit * 2, "_n",
    ).drop("_n")
    fallback = segments.select(*keys).join(spare, "request_id").select(*keys, "ord", F.lit(1).alias("tier"))
    best = overlapping.unionByName(named).unionByName(fallback).groupBy(*keys, "ord").agg(F.min("tier").alias("tier"))
    return top_k(best, keys, [F.col("tier"), F.col("ord")], limit)


def coverage_status(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """sufficient, insufficient or unresolved per question, from its evidence rows alone."""
    exact = F.col("resolution").isin("exact", "enclosing")
    per_symbol = evidence.groupBy("request_id", "symbol").agg(
        F.bool_or(F.coalesce(F.col("resolution") == "ambiguous_candidate", F.lit(False))).alias("open"),
        F.bool_or(F.coalesce(exact, F.lit(False))).alias("settled"),
        F.count("*").alias("rows"),
        F.count_if(F.col("relation").isin(*GRAPH)).alias("relations"),
        F.count_if(F.col("relation") == "definition").alias("definitions"),
    )
    spans = evidence.filter("symbol IS NOT NULL").select("request_id", *SPAN).distinct().groupBy("request_id").agg(
        F.count("*").alias("spans")
    )
    facts = per_symbol.groupBy("request_id").agg(
        F.bool_or("open").alias("open"),
        F.bool_or(F.col("open") & F.col("settled") & F.col("symbol").isNotNull()).alias("settled"),
        F.sum("rows").alias("rows"), F.sum("relations").alias("relations"), F.sum("definitions").alias("definitions"),
    )
    known = questions.join(facts, "request_id", "left").join(spans, "request_id", "left").na.fill(
        0, ["rows", "relations", "definitions", "spans"]
    ).na.fill(False, ["open", "settled"])
    q = F.col("question")
    enough = (
        F.when(intents.asks(q, intents.MULTI_HOP), (F.col("spans") >= 3) & (F.col("relations") >= 2))
        .when(intents.asks(q, intents.RELATION), F.col("relations") > 0)
        .when(intents.asks(q, intents.IMPLEMENTATION), F.col("definitions") > 0)
        .otherwise(F.col("rows") > 0)
    )
    return known.select(
        "request_id",
        F.when(F.col("open") & ~F.col("settled"), "unresolved").when(enough, "sufficient").otherwise("insufficient")
        .alias("status"),
    )


def preflight_verdict(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Whether the prefetched evidence already answers the question, and if not, why.

    questions need `ambiguous` (an identifier had several candidates).
    """
    facts = evidence.groupBy("request_id").agg(
        F.count("*").alias("rows"),
        F.bool_or((F.col("relation") == "definition") & F.coalesce(F.col("resolution").isin("exact", "enclosing"), F.lit(False))).alias("exact"),
        F.bool_or(F.col("relation").isin(*GRAPH)).alias("related"),
    )
    known = questions.join(facts, "request_id", "left").na.fill(0, ["rows"]).na.fill(False, ["exact", "related"])
    q = F.col("question")
    # The reason given for each verdict.
    reason = (
        F.when(F.col("ambiguous"), "目标符号存在多个同名候选，必须继续消歧")
        .when(intents.asks(q, intents.MULTI_HOP), "问题要求多跳关系，确定性预取仅覆盖一跳，必须继续追踪")
        .when(intents.asks(q, intents.IMPLEMENTATION) & ~F.col("exact"), "实现类问题缺少精确定义")
        .when(intents.asks(q, intents.RELATION) & ~F.col("related"), "调用或影响问题缺少引用/调用边")
        .when(F.col("rows") == 0, "尚未找到可验证的源码证据")
    )
    return known.select(
        "request_id", reason.isNull().alias("sufficient"),
        F.coalesce(reason, F.lit("确定性预取已覆盖问题所需证据")).alias("reason"),
        (F.col("exact") & ~intents.asks(q, intents.CALLER_FOCUS) & ~intents.asks(q, intents.MULTI_HOP) & ~F.col("ambiguous"))
        .alias("direct_target"),
        intents.asks(q, intents.MULTI_HOP).alias("multi_hop"),
    )


def ambiguous_answers(evidence: DataFrame) -> DataFrame:
    """Per request: the symbol names in question and the locators of all candidates."""
    names = evidence.filter("symbol IS NOT NULL").select("request_id", "symbol").distinct().groupBy("request_id").agg(
        F.array_join(F.array_sort(F.collect_list("symbol")), " / ").alias("target")
    )
    places = evidence.groupBy("request_id").agg(joined(locator(), F.col("ord"), "；").alias("locators"))
    return places.join(names, "request_id", "left").withColumn("target", F.coalesce("target", F.lit("目标符号")))


def answer_chain(evidence: DataFrame) -> DataFrame:
    """Qualified names in order, without classes that contain another name, once per span.

    "Contains" is an equi-join: every name offers its dotted prefixes.
    """
    parts = F.split("qualified_name", r"\.")
    prefixes = evidence.select(
        "request_id",
        F.explode(F.transform(
            F.slice(parts, F.lit(1), F.size(parts) - 1), lambda _p, i: F.array_join(F.slice(parts, F.lit(1), i + 1), ".")
        )).alias("qualified_name"),
    ).distinct().withColumn("_outer", F.lit(True))
    kept = evidence.join(prefixes, ["request_id", "qualified_name"], "left").filter(
        ~(F.coalesce("_outer", F.lit(False)) & (F.col("kind") == "class")) & (F.col("qualified_name") != "")
    )
    once = kept.groupBy("request_id", *SPAN, "qualified_name").agg(F.min("ord").alias("ord"))
    return once.groupBy("request_id").agg(joined(F.col("qualified_name"), F.col("ord"), " → ").alias("chain"))


def merge_new(initial: DataFrame, found: DataFrame) -> DataFrame:
    """Counts, per request, what freshly read rows add to the known ones by (path, span, hash)."""
    key = ["request_id", *SPAN, "source_hash"]
    fresh = found.select(*key).distinct().join(initial.select(*key).distinct(), key, "left_anti")
    counted = found.select("request_id").distinct().join(
        fresh.groupBy("request_id").agg(F.count("*").alias("new_rows")), "request_id", "left"
    ).na.fill(0, ["new_rows"])
    return counted.withColumn("no_progress", F.col("new_rows") == 0)


def append_footer(answer: Column, locators: Column) -> Column:
    """Attach up to five locators to an answer that cites nothing."""
    bare = (answer != "") & (F.size(locators) > 0) & ~answer.rlike(r"\[E\d+\]")
    note = F.concat(F.lit("\n\n证据定位："), F.array_join(F.slice(locators, 1, 5), "；"))
    return F.when(bare, F.concat(answer, note)).otherwise(answer)


def filter_citations(text: Column, valid: Column) -> Column:
    """struct(text, invalid): unknown [E#] marks removed in one pass, and the ids that were."""
    marks = F.regexp_extract_all(text, F.lit(r"\[E\d+\]"), 0)
    pieces = F.split(text, r"\[E\d+\]")
    bare = F.transform(marks, lambda m: F.substring(m, F.lit(2), F.length(m) - 2))
    kept = F.transform(bare, lambda e: F.when(F.array_contains(valid, e), F.concat(F.lit("["), e, F.lit("]"))).otherwise(F.lit("")))
    rebuilt = F.array_join(
        F.transform(pieces, lambda piece, i: F.concat(piece, F.coalesce(F.get(kept, i), F.lit("")))), ""
    )
    return F.struct(rebuilt.alias("text"), F.array_sort(F.array_except(bare, valid)).alias("invalid"))
