"""The data source of source trees against the scan of a table of roots and against a plain walk."""

import os
import random

from pyspark.sql import functions as F

from codequarry.functions import paths as px
from codequarry.options import Options
from codequarry.sources import code_tree, tree_source


def write(root, files):
    for name, body in files.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body if isinstance(body, bytes) else body.encode())


FILES = {
    "pkg/__init__.py": "x = 1\n", "_private/.hidden/_a.py": "y = 2\n", ".gitignore": "secret/\n!secret/keep.py\n*.log\n/top.py\n# note\n\\#odd\n",
    "secret/a.py": "no", "secret/keep.py": "yes = 1\n", "run.log": "no", "top.py": "no", "sub/top.py": "ok", "#odd": "no", "README": "hello",
    "node_modules/x.js": "no", "cn.txt": "数据".encode("gb18030"), "bin.txt": b"a\x00b", "big.txt": "x" * 3000, "bom.md": b"\xef\xbb\xbf# t\n", "empty.py": "",
    "vendor/lib.py": "z = 1\n",
}


def load(spark, root, **options):
    tree_source.register(spark)
    return spark.read.format("code_tree").options(project="p", **options).load(str(root))


def test_source_equals_the_scan(spark, tmp_path):
    write(tmp_path, FILES | {f"deep/{i % 5}/{i % 3}/m{i}.py": f"v = {i}\n" for i in range(40)})
    roots = spark.createDataFrame([("p", str(tmp_path))], "project_id string, root string")
    columns = ["path", "size", "mtime_ns", "content", "source_hash", "problem"]
    scanned = code_tree.scan_tree(spark, roots, Options(max_file_bytes=2000)).select(*columns)
    for partitions in ("1", "4", "200"):
        found = load(spark, tmp_path, partitions=partitions, maxFileBytes="2000")
        known = found.withColumn("language", px.language(F.col("path"))).filter("language IS NOT NULL").select(*columns)
        assert sorted(map(repr, known.collect())) == sorted(map(repr, scanned.collect()))
        assert partitions == "1" or found.rdd.getNumPartitions() > 1
    assert {r.path for r in found.collect()} >= {"pkg/__init__.py", "_private/.hidden/_a.py", ".gitignore"}


def test_options(spark, tmp_path):
    write(tmp_path, FILES)
    listed = {r.path: r for r in load(spark, tmp_path, content="false", ignoreFiles="", skipDirs="vendor,sub").collect()}
    assert set(listed) == {f for f in FILES if not f.startswith(("node_modules/", "vendor/", "sub/"))}
    assert all(r.content is None and r.source_hash is None and r.problem is None for r in listed.values())
    small = load(spark, tmp_path, batchBytes="1")
    assert small.count() == load(spark, tmp_path).count()
    assert load(spark, tmp_path / "missing").first().problem == "FileNotFoundError"


def test_rules_equal_the_column_rules(spark):
    rng = random.Random(5)
    names = ["a", "b.py", "c.log", "src", "a b", "[x]", "x1"]
    patterns = ["a", "/a", "a/", "*.py", "!b.py", "src/*", "/src/a/", "**/a", "a?", "x[0-9]", "x[!0-9]", "  ", "#c", "\\#c", "\\!a", "src/**", "!src/a", "*", "!*/"]
    cases = []
    for i in range(150):
        rules = [rng.choice(patterns) for _ in range(rng.randint(0, 4))]
        cases.append((i, "/".join(rng.choice(names) for _ in range(rng.randint(1, 4))), rules))
    rows = spark.createDataFrame(cases, "i int, path string, lines array<string>")
    parsed = F.filter(F.transform("lines", px.parse_ignore_rule), lambda r: r.isNotNull())
    columns = {r.i: r.x for r in rows.select("i", px.is_ignored(F.col("path"), parsed).alias("x")).collect()}
    for i, path, lines in cases:
        rules = [rule for rule in map(tree_source.parse_rule, lines) if rule]
        assert tree_source.ignored(path, rules) == columns[i], (path, lines)


def test_a_walk_finds_the_same(spark, tmp_path):
    rng = random.Random(1)
    write(tmp_path, {"/".join(rng.choice("abcde_.") + "d" for _ in range(rng.randint(1, 5))) + f"/f{i}.txt": str(i) for i in range(80)})
    walked = {os.path.relpath(os.path.join(at, name), tmp_path) for at, _, names in os.walk(tmp_path) for name in names}
    found = load(spark, tmp_path, partitions="7").collect()
    assert {r.path for r in found} == walked and len(found) == len(walked)
