"""Registry of named queries: the Spark job and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    job: Job
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def register(job: Job) -> Job:
        if name in _ENTRIES:
            raise ValueError(f"query {name} registered twice")
        _ENTRIES[name] = Entry(name, job, sql)
        return job

    return register


def entries() -> dict[str, Entry]:
    return dict(_ENTRIES)
