"""`spark.read.format("code_tree")`: source trees as a data source, one partition per batch of directories.

Planning lists only as many levels as it takes to have enough directories; below them each task walks and
reads its own part. Names that begin with `_` or `.` are files like any other. Options:

- `path`: the root, which all executors must be able to open; `project`: its project_id;
- `partitions`: batches of directories to aim at; `batchBytes`: text held before rows are passed on;
- `content`: false leaves texts and hashes null and opens no file;
- `maxFileBytes`: larger files keep their row, with a problem instead of a text;
- `skipDirs`: names of directories, comma-separated, to leave out besides the fixed ones;
- `ignoreFiles`: files of the root with ignore rules, comma-separated; empty for none.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
import sys
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codequarry.functions.paths import SKIPPED_DIRS
from codequarry.options import DEFAULTS
from codequarry.sources import code_tree
from codequarry.sources.code_tree import decode

# Planning runs in a process of its own that sees no shipped archive, so the code travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(code_tree)

SCHEMA = "project_id string, root string, path string, size bigint, mtime_ns bigint, content string, source_hash string, problem string"
MAX_FILE_BYTES = DEFAULTS.max_file_bytes


@dataclass(frozen=True)
class Rule:
    """One ignore rule; `directory_only` covers what lies below, never a file of that name."""

    pattern: str
    negated: bool
    directory_only: bool
    anchored: bool

    def covers(self, path: str) -> bool:
        parts = path.split("/")
        last = len(parts) - 1 if self.directory_only else len(parts)
        match = re.compile(fnmatch.translate(self.pattern)).match
        if not self.anchored and "/" not in self.pattern:
            return any(match(part) for part in parts[:last])
        upto = ["/".join(parts[: i + 1]) for i in range(last)]
        floating = re.compile(fnmatch.translate("*/" + self.pattern)).match
        return any(match(p) or (not self.anchored and floating(p)) for p in upto)


def parse_rule(line: str) -> Rule | None:
    text = line.rstrip(" ")
    if not text or text.lstrip(" ").startswith("#"):
        return None
    body = re.sub(r"^\\(?=#)", "", re.sub(r"^!|^\\(?=!)", "", text))
    pattern = body.strip("/")
    return Rule(pattern, text.startswith("!"), body.endswith("/"), body.startswith("/")) if pattern else None


def ignored(path: str, rules: list[Rule]) -> bool:
    """The last rule that covers a path decides."""
    return next((not rule.negated for rule in reversed(rules) if rule.covers(path)), False)


@dataclass
class Directories(InputPartition):
    """Directories of one task: (path, whole); a directory that isn't whole gives its own files only."""

    entries: list[tuple[str, bool]]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options.get("path", "")
        if not self.root:
            raise ValueError("code_tree needs a path")
        self.project = options.get("project", os.path.basename(self.root.rstrip("/")))
        self.wanted = int(options.get("partitions", "32"))
        self.batch_bytes = int(options.get("batchbytes", str(32_000_000)))
        self.content = options.get("content", "true").lower() != "false"
        self.max_file_bytes = int(options.get("maxfilebytes", str(MAX_FILE_BYTES)))
        self.skipped = {*SKIPPED_DIRS, *filter(None, options.get("skipdirs", "").split(","))}
        self.ignore_files = [name for name in options.get("ignorefiles", ".gitignore").split(",") if name]

    def _listed(self, path: str) -> tuple[list[str], list[tuple[str, os.stat_result]]]:
        """Directories and files right below a directory; links to directories aren't followed."""
        below, files = [], []
        with os.scandir(os.path.join(self.root, path)) as found:
            for entry in found:
                inner = f"{path}/{entry.name}" if path else entry.name
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in self.skipped:
                        below.append(inner)
                elif entry.is_file():
                    files.append((inner, entry.stat()))
        return sorted(below), sorted(files, key=lambda item: item[0])

    def partitions(self) -> list[InputPartition]:
        shallow, open_ends = [], deque([""])
        while open_ends and len(open_ends) < self.wanted:
            path = open_ends.popleft()
            shallow.append((path, False))
            try:
                open_ends.extend(self._listed(path)[0])
            except OSError:
                # The task that gets the directory reports the problem.
                continue
        entries = [*shallow, *((path, True) for path in open_ends)]
        batches = [entries[i :: self.wanted] for i in range(self.wanted)]
        return [Directories(batch) for batch in batches if batch]

    def _rules(self) -> list[Rule]:
        lines = []
        for name in self.ignore_files:
            try:
                with open(os.path.join(self.root, name), "rb") as handle:
                    lines += re.split("\r?\n", decode(handle.read()) or "")
            except OSError:
                continue
        return [rule for rule in map(parse_rule, lines) if rule is not None]

    def _row(self, path: str, stat: os.stat_result) -> tuple:
        place = (self.project, self.root, path, stat.st_size, stat.st_mtime_ns)
        if stat.st_size > self.max_file_bytes:
            return (*place, None, None, "too_large")
        if not self.content:
            return (*place, None, None, None)
        try:
            with open(os.path.join(self.root, path), "rb") as handle:
                data = handle.read()
        except OSError as problem:
            return (*place, None, None, type(problem).__name__)
        text = decode(data)
        return (*place, text, hashlib.sha256(data).hexdigest(), None if text is not None else "binary")

    def read(self, partition: Directories) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        kinds = [pa.int64() if field.endswith("bigint") else pa.string() for field in SCHEMA.split(", ")]
        rules, todo = self._rules(), deque(partition.entries)
        rows, held = [], 0

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        while todo:
            path, whole = todo.popleft()
            try:
                below, files = self._listed(path)
            except OSError as problem:
                rows.append((self.project, self.root, path, None, None, None, None, type(problem).__name__))
                continue
            if whole:
                # Depth first, so that few directories wait.
                todo.extendleft((inner, True) for inner in reversed(below))
            for inner, stat in files:
                if ignored(inner, rules):
                    continue
                rows.append(self._row(inner, stat))
                held += len(rows[-1][5] or "") + 200
                if held >= self.batch_bytes:
                    yield passed_on()
                    rows, held = [], 0
        if rows:
            yield passed_on()


class CodeTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "code_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader({key.lower(): value for key, value in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CodeTree)
