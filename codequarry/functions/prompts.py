"""Prompt rows: message arrays built from templates, and their canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def message(role: str, content: Column) -> Column:
    return F.struct(content.alias("content"), F.lit(role).alias("role"))


def canonical(messages: Column) -> Column:
    """Compact JSON with sorted keys; `message` already lists its fields in that order."""
    return F.to_json(messages)


def optional_block(lead: str, text: Column, tail: str = "") -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(lead), text, F.lit(tail)))


def joined_context(*parts: Column) -> Column:
    return F.concat_ws("\n\n", *parts)


def overview_messages(system: str, name: Column, content: Column, label: Column, language: Column, context: Column) -> Column:
    body = F.concat(
        F.coalesce(optional_block("以下是项目级背景：\n", context, "\n\n"), F.lit("")),
        F.lit("下面是文件 "), name, F.lit(" 的"), label, F.lit("：\n\n```"), language, F.lit("\n"), content, F.lit("\n```"),
    )
    return F.array(message("system", F.lit(system)), message("user", body))


def segment_messages(
    system: str, name: Column, overview: Column, imports: Column, kind: Column, title: Column, start: Column,
    end: Column, code: Column, language: Column, context: Column,
) -> Column:
    fenced = F.when(
        ~kind.isin("imports", "docstring") & (F.coalesce(imports, F.lit("")) != ""),
        F.concat(F.lit("该文件的导入依赖：\n```"), language, F.lit("\n"), imports, F.lit("\n```")),
    )
    lead = joined_context(
        optional_block("该文件的总览：", overview), fenced, optional_block("项目级上下文：\n", context)
    )
    body = F.concat(
        F.when(lead != "", F.concat(lead, F.lit("\n\n"))).otherwise(F.lit("")),
        F.lit("现在请解读文件 "), name, F.lit(" 第 "), start, F.lit("~"), end, F.lit(" 行的「"), title, F.lit("」：\n\n```"),
        language, F.lit("\n"), code, F.lit("\n```"),
    )
    return F.array(message("system", F.lit(system)), message("user", body))


def chat_messages(system: str, name: Column, context: Column, history: Column, question: Column, ack: str) -> Column:
    """history is an ARRAY<STRUCT<content, role>> already cut to the last messages."""
    lead = joined_context(F.concat(F.lit("当前正在阅读的文件："), name), optional_block("项目级上下文：\n", context))
    head = F.array(
        message("system", F.lit(system)), message("user", F.concat(F.lit("【代码上下文】\n"), lead)),
        message("assistant", F.lit(ack)),
    )
    return F.concat(head, history, F.array(message("user", question)))
