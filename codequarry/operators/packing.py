"""Fitting ranked evidence into token budgets. Lists are per request and already cut by retrieval."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.operators.fusion import tier
from codequarry.operators.topk import within_budget

# Spans over 120 lines break into 100-line fragments, each a little less relevant.
FRAGMENT_OVER = 120
FRAGMENT_LINES = 100
FRAGMENT_STEP = 0.002


def fragments(evidence: DataFrame) -> DataFrame:
    """Split long spans whose text has exactly the lines its span claims."""
    lines = tx.lines_of(F.col("content"))
    claimed = F.col("end_line") - F.col("start_line") + 1
    split = (claimed > FRAGMENT_OVER) & (F.size(lines) == claimed)
    last = F.when(split, claimed - 1).otherwise(F.lit(0))
    kept = [c for c in evidence.columns if c not in ("start_line", "end_line", "content", "score")]
    pieces = evidence.withColumn("_lines", lines).withColumn("_split", split).withColumn("_claimed", claimed).select(
        "*", F.posexplode(F.sequence(F.lit(0), last.cast("int"), F.lit(FRAGMENT_LINES))).alias("continuation_index", "_from")
    )
    end = F.least(F.col("_from") + FRAGMENT_LINES, F.col("_claimed"))
    return pieces.select(
        *kept,
        F.when(F.col("_split"), F.col("continuation_index")).alias("continuation_index"),
        (F.col("start_line") + F.col("_from")).alias("start_line"),
        F.when(F.col("_split"), F.col("start_line") + end - 1).otherwise(F.col("end_line")).alias("end_line"),
        F.when(F.col("_split"), tx.join_lines(F.slice("_lines", F.col("_from") + 1, FRAGMENT_LINES)))
        .otherwise(F.col("content")).alias("content"),
        F.when(F.col("_split"), F.greatest(F.lit(0.0), F.col("score") - F.col("continuation_index") * FRAGMENT_STEP))
        .otherwise(F.col("score")).alias("score"),
    )


def rendered() -> Column:
    symbol = F.when(F.coalesce("symbol", F.lit("")) != "", F.concat(F.lit(" · "), "symbol")).otherwise(F.lit(""))
    return F.concat(
        F.lit("["), "relation", F.lit("] "), "path", F.lit(":"), "start_line", F.lit("-"), "end_line", symbol,
        F.lit("\n"), "content",
    )


def _counted(counter: Callable[[str], int], available: int) -> Callable[[Column], Column]:
    """Greedy choice with a tokenizer, whose counts don't add up: every candidate text is counted as a whole."""

    @F.pandas_udf("kept array<int>, tokens int")
    def choose(lists: pd.Series) -> pd.DataFrame:
        rows = []
        for blocks in lists:
            text, kept = "", []
            for i, block in enumerate(blocks):
                candidate = f"{text}\n\n{block}" if kept else block
                if counter(candidate) <= available:
                    text = candidate
                    kept.append(i)
            rows.append((kept, min(available, max(0, counter(text)))))
        return pd.DataFrame(rows, columns=["kept", "tokens"])

    return choose


def pack(
    evidence: DataFrame, window_tokens: int, output_reserve: int, system_reserve: int, history_reserve: int,
    chars_per_token: int = 3, counter: Callable[[str], int] | None = None,
) -> DataFrame:
    """Greedy packing per request: a block that no longer fits is left out and the next one is tried.

    That choice depends on all earlier ones, so it is a fold over the request's ordered array; the
    state is one length and the kept places, not the text. With a `counter`, which the tasks call, real
    tokens count instead of the estimate by length.
    """
    requested = output_reserve + system_reserve + history_reserve
    reserved, available = min(window_tokens, requested), max(0, window_tokens - requested)
    order = F.struct(
        tier(F.col("relation")).alias("tier"), (-F.col("score")).alias("worth"), F.lower("path").alias("low"),
        F.col("start_line").alias("line"), F.col("ord").alias("ord"), rendered().alias("block"),
    )
    lists = evidence.groupBy("request_id").agg(F.array_sort(F.collect_list(order)).alias("items"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("seen"), F.array().cast("array<int>").alias("kept"))

    def step(state: Column, item: Column) -> Column:
        total = state["used"] + F.length(item["block"]) + F.when(F.size(state["kept"]) > 0, 2).otherwise(0)
        fits = F.greatest(F.lit(1), F.floor(total / chars_per_token)) <= available
        return F.struct(
            F.when(fits, total).otherwise(state["used"]).alias("used"),
            (state["seen"] + 1).alias("seen"),
            F.when(fits, F.concat(state["kept"], F.array(state["seen"]))).otherwise(state["kept"]).alias("kept"),
        )

    if counter is None:
        folded = lists.withColumn("_state", F.aggregate("items", start, step))
        spent = F.greatest(F.lit(1), F.floor(F.col("_state.used") / chars_per_token)).cast("int")
    else:
        folded = lists.withColumn("_state", _counted(counter, available)(F.transform("items", lambda x: x["block"])))
        spent = F.col("_state.tokens")
    kept = F.transform(F.col("_state.kept"), lambda i: F.get("items", i))
    omitted = F.size("items") - F.size("_state.kept")
    tokens = F.least(F.lit(available), spent)
    exhausted = F.when(F.lit(requested >= window_tokens), F.lit("系统、历史与输出预留已耗尽上下文预算"))
    short = F.when(omitted > 0, F.concat(F.lit("受 token 预算限制，已省略 "), omitted, F.lit(" 条证据")))
    return folded.select(
        "request_id",
        F.array_join(F.transform(kept, lambda x: x["block"]), "\n\n").alias("text"),
        F.transform(kept, lambda x: x["ord"]).alias("kept"),
        F.transform(
            F.filter("items", lambda x, i: ~F.array_contains(F.col("_state.kept"), i)), lambda x: x["ord"]
        ).alias("omitted"),
        tokens.alias("evidence_tokens"),
        F.least(F.lit(window_tokens), F.lit(reserved) + tokens).alias("used_tokens"),
        F.lit(reserved).alias("reserved_tokens"), F.lit(available).alias("available_tokens"),
        F.concat_ws("；", exhausted, short).alias("warning"),
    )


def trim_to_limit(evidence: DataFrame, base_tokens: Column, limit: int) -> DataFrame:
    """Longest prefix of a packed list that fits beside the base tokens (the lowest rows go first)."""
    return within_budget(
        evidence, ["request_id"], [F.col("ord")], tx.estimate_tokens(F.col("content")), F.lit(limit) - base_tokens
    )


def definition_windows(start_line: Column, end_line: Column, focus: Column) -> Column:
    """Line windows kept of a definition over 200 lines: head, around the focus, tail; merged if touching."""
    count = end_line - start_line + 1
    head = F.struct(F.lit(0).alias("a"), F.least(F.lit(79), count - 1).alias("b"))
    middle = focus - start_line
    around = F.struct(
        F.greatest(F.lit(0), middle - 45).alias("a"), F.least(count - 1, middle + 45).alias("b")
    )
    tail = F.struct(F.greatest(F.lit(0), count - 35).alias("a"), (count - 1).alias("b"))
    focused = focus.isNotNull() & (focus >= start_line) & (focus <= end_line)
    raw = F.array_sort(F.when(focused, F.array(head, around, tail)).otherwise(F.array(head, tail)))

    def merge(done: Column, item: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        touching = (F.size(done) > 0) & (item["a"] <= last["b"] + 1)
        widened = F.struct(last["a"].alias("a"), F.greatest(last["b"], item["b"]).alias("b"))
        body = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(touching, F.concat(body, F.array(widened))).otherwise(F.concat(done, F.array(item)))

    empty = F.filter(raw, lambda _w: F.lit(False))
    merged = F.aggregate(raw, empty, merge)
    whole = F.array(F.struct(F.lit(0).alias("a"), (count - 1).alias("b")))
    return F.when(count > 200, merged).otherwise(whole)


def compact_results(items: DataFrame, limit_chars: int, content_chars: int = 1200) -> DataFrame:
    """Items of a tool result, contents shortened, kept until the character budget (less 500) is spent."""
    short = items.withColumn("content", F.substring("content", 1, content_chars))
    encoded = short.withColumn("encoded", F.to_json(F.struct("path", "start_line", "content")))
    return within_budget(
        encoded, ["request_id"], [F.col("ord")], F.length("encoded"), max(0, limit_chars - 500)
    )


def overview_budget(max_chars: Column) -> Column:
    return F.least(F.lit(4500), F.greatest(F.lit(1200), F.floor(max_chars * 0.38)))


OVERVIEW_SUFFIX = "\n- …（项目地图受上下文预算限制，已省略较低优先级文件）"


def shortened(text: Column, budget: Column, suffix: str = OVERVIEW_SUFFIX) -> Column:
    room = F.greatest(F.lit(0), budget - len(suffix))
    return F.when(F.length(text) <= budget, text).otherwise(
        F.concat(F.substring(text, F.lit(1), room.cast("int")), F.lit(suffix))
    )


def cap_calls(calls: DataFrame, same_limit: int = 2, batch: int = 3, total: int = 8) -> DataFrame:
    """calls(session, step, ord, signature): what each step may still run.

    Only the first `batch` calls of a step count, and at most as many as the session has left; of
    those, a signature runs `same_limit` times. Steps depend on earlier ones, so this folds over the
    session's few calls.
    """
    from codequarry.operators.topk import top_k

    first = top_k(calls, ["session", "step"], [F.col("ord")], batch, "_n")
    item = F.struct("step", "_n", "ord", "signature")
    lists = first.groupBy("session").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(
        F.lit(None).cast("int").alias("step"), F.lit(0).alias("before"), F.array().cast("array<string>").alias("ran"),
        F.array().cast("array<boolean>").alias("flags"),
    )

    def step(state: Column, call: Column) -> Column:
        same_step = F.coalesce(state["step"] == call["step"].cast("int"), F.lit(False))
        before = F.when(same_step, state["before"]).otherwise(F.size(state["ran"]))
        considered = call["_n"] <= F.least(F.lit(batch), F.greatest(F.lit(0), total - before))
        repeats = F.size(F.filter(state["ran"], lambda s: s == call["signature"]))
        runs = considered & (repeats < same_limit)
        return F.struct(
            call["step"].cast("int").alias("step"), before.alias("before"),
            F.when(runs, F.concat(state["ran"], F.array(call["signature"]))).otherwise(state["ran"]).alias("ran"),
            F.concat(state["flags"], F.array(runs)).alias("flags"),
        )

    folded = lists.withColumn("flags", F.aggregate("items", start, step, lambda s: s["flags"]))
    return folded.select("session", F.explode(F.arrays_zip("items", "flags")).alias("z")).select(
        "session", "z.items.step", "z.items.ord", "z.items.signature", F.col("z.flags").alias("runs")
    )


def pressure(base_tokens: Column, output_reserve: int, context: int, soft: float, hard: float) -> list[Column]:
    """Whether to announce compaction, and whether to drop the checkpoint and older messages."""
    return [
        (base_tokens >= int(context * soft)).alias("compacting"),
        (base_tokens + output_reserve >= int(context * hard)).alias("drop_checkpoint"),
    ]


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row per key in the place of the first: repeated definitions in one scope."""
    payload = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), order).alias("_row"), F.min(order).alias("slot")
    ).select(*keys, "_row.*", "slot")
