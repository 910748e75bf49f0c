"""The same rules for SQL users: two SQL functions and one table function, registered per session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_NORM_PATH = r"""CREATE OR REPLACE TEMPORARY FUNCTION norm_path(p STRING) RETURNS STRING
RETURN array_join(filter(split(replace(p, '\\', '/'), '/'), x -> x NOT IN ('', '.')), '/')"""
_GLOB = r"""CREATE OR REPLACE TEMPORARY FUNCTION glob_to_regex(g STRING) RETURNS STRING
RETURN concat('(?s)^', replace(replace(replace(regexp_replace(g, '([.\\\\+^$(){}|])', '\\\\$1'), '*', '.*'), '?', '.'), '[!', '[^'), '$')"""


@udtf(returnType="kind string, title string, start_line int, end_line int, strategy string")
class CodeSegments:
    """code_segments(text, extension): raw segments of one file; gaps are not filled."""

    def __init__(self):
        from codequarry.operators.apart import Apart
        from codequarry.operators.segments import python_structure

        self.parsed = Apart(python_structure)

    def terminate(self):
        self.parsed.close()
        yield from ()

    def eval(self, text: str, extension: str):
        if text is None or (extension or "").lower().lstrip(".") not in ("py", "pyw"):
            return
        for row in self.parsed(text, len(text)):
            if row["fact"] == "segment":
                yield row["kind"], row["title"], row["start_line"], row["end_line"], row["strategy"]


def register(spark: SparkSession) -> None:
    spark.sql(_NORM_PATH)
    spark.sql(_GLOB)
    spark.udtf.register("code_segments", CodeSegments)
