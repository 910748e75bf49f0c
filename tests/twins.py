"""Run a registered query and its SQL twin on the same tables and report the first differences."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def sql_connection(directory: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{Path(directory) / table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        number = float(value)
        return "nan" if math.isnan(number) else round(number, 6)
    return str(value)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, job, sql: str, directory: str) -> list[str]:
    frame = job(spark, directory)
    ours = _table(frame.columns, [tuple(row) for row in frame.collect()])
    con = sql_connection(directory)
    result = con.execute(sql)
    theirs = _table([d[0] for d in result.description], result.fetchall())
    problems = []
    if ours[0] != theirs[0]:
        problems.append(f"columns {ours[0]} != {theirs[0]}")
    if len(ours[1]) != len(theirs[1]):
        problems.append(f"rows {len(ours[1])} != {len(theirs[1])}")
    if ours[1] != theirs[1]:
        ours_set, theirs_set = set(map(repr, ours[1])), set(map(repr, theirs[1]))
        problems += [f"spark only {row[:600]}" for row in sorted(ours_set - theirs_set)[:3]]
        problems += [f"sql only   {row[:600]}" for row in sorted(theirs_set - ours_set)[:3]]
        if not problems:
            problems.append("same sets, different multiplicities")
    if not ours[1]:
        problems.append("no rows")
    return problems
