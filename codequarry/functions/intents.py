"""What a question asks for, as four regular-expression flags."""

from __future__ import annotations

from pyspark.sql import Column

# The wordings that mark each intent, matched anywhere and in any case.
IMPLEMENTATION = "实现|内部|源码|逻辑|怎么做|如何做|implement|implementation|definition|source"
RELATION = "调用|引用|影响|谁用|调用链|caller|callee|reference|impact|used by"
MULTI_HOP = (
    r"(?:两|三|[2-9])\s*跳|多跳|完整调用链|最终调用|最终读取|"
    r"two[- ]hop|multi[- ]hop|transitive|depth\s*[2-9]"
)
CALLER_FOCUS = (
    "谁(?:在)?调用|哪里调用|哪些.*调用|被.*调用|调用链|引用|影响|caller|reference|impact|used by"
)


def asks(question: Column, pattern: str) -> Column:
    return question.rlike(f"(?i){pattern}")


def flags(question: Column) -> list[Column]:
    return [
        asks(question, IMPLEMENTATION).alias("implementation"),
        asks(question, RELATION).alias("relation"),
        asks(question, MULTI_HOP).alias("multi_hop"),
        asks(question, CALLER_FOCUS).alias("caller_focus"),
    ]
