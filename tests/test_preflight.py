"""The composite preflight on a small resolved source tree."""

from pyspark.sql import functions as F
from test_code import LAYERED, corpus

from codequarry.functions import text as tx
from codequarry.operators import chunks as ck
from codequarry.operators import facts as fa
from codequarry.operators import lookup, preflight, repo_map, resolve, search


def test_preflight_on_a_layered_project(spark):
    long_body = "def marathon():\n" + "".join(f"    step_{i} = {i}\n" for i in range(260)) + "    return step_0\n"
    files = corpus(spark, {**LAYERED, "long.py": long_body}).withColumn("lines", tx.lines_of(F.col("content")))
    files = files.withColumn("line_count", F.size("lines")).withColumn("source_hash", F.sha2("content", 256)).withColumn("language", F.lit("python"))
    facts = fa.extract_facts(files).cache()
    place = files.select("file_id", "language", "source_hash")
    symbols = fa.symbols(facts).join(place, "file_id").cache()
    calls = resolve.resolve_calls(resolve.with_caller_ids(fa.calls(facts), symbols), symbols, fa.imports(facts)).join(place, "file_id").cache()
    chunks = ck.text_chunks(files).withColumn("chunk_id", F.col("file_id") * 1000 + F.col("start_line")).cache()
    asked = spark.createDataFrame(
        [(1, "p", "caller of handle", "cli.py"), (2, "p", "how is ping implemented", "cli.py"), (3, "p", "implementation of marathon", "cli.py"),
         (4, "p", "implement nothing_like_this", "cli.py"), (5, "p", "two-hop chain from label", "cli.py")],
        "request_id long, project_id string, question string, current_file string",
    )
    anchors = files.filter("path = 'decoy.py'").select(
        F.lit(1).cast("long").alias("request_id"), F.lit(1).alias("ord"), "path", F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), "source_hash",
    ).unionByName(spark.createDataFrame(
        [(1, 2, "utils/text.py", 1, 2, "stale")], "request_id long, ord int, path string, start_line int, end_line int, source_hash string"))
    stored = preflight.Corpus(files, symbols, calls, chunks)
    rows, verdicts = preflight.gather(asked, stored, anchors)
    found = rows.collect()
    said = {r.request_id: r for r in verdicts.collect()}
    assert said[1].sufficient and not said[1].direct_target
    assert not said[2].sufficient and "同名候选" in said[2].reason
    assert said[3].sufficient and said[3].direct_target
    assert not said[4].sufficient and "缺少精确定义" in said[4].reason
    assert not said[5].sufficient and said[5].multi_hop

    of = lambda request, **want: [r for r in found if r.request_id == request and all(r[k] == v for k, v in want.items())]
    assert of(1, resolution="exact", symbol="handle")[0].path == "services/api.py"
    assert of(1, relation="caller", symbol="main") and of(1, relation="callee", symbol="finish")
    assert of(1, resolution="anchor", path="decoy.py") and not of(1, resolution="anchor", path="utils/text.py")
    assert {r.path for r in of(2, resolution="ambiguous_candidate")} == {"services/api.py", "decoy.py"}
    assert [(r.start_line, r.end_line) for r in sorted(of(3, resolution="exact"), key=lambda r: r.start_line)] == [(1, 80), (228, 262)]
    sources = {r.path: r.lines for r in files.collect()}
    assert all("\n".join(sources[r.path][r.start_line - 1:r.end_line]) == r.content for r in found)


def _indexed(spark, trees):
    """Files, symbols, calls, chunks and imports of several small projects."""
    from pyspark.sql import Row

    from codequarry.functions import paths as px

    rows = [
        Row(project_id=project, file_id=1000 * n + i, path=path, content=source)
        for n, (project, tree) in enumerate(sorted(trees.items())) for i, (path, source) in enumerate(sorted(tree.items()))
    ]
    files = spark.createDataFrame(rows, "project_id string, file_id long, path string, content string").withColumn("module", px.module_name(F.col("path")))
    files = files.withColumn("lines", tx.lines_of(F.col("content"))).withColumn("line_count", F.size("lines"))
    files = files.withColumn("source_hash", F.sha2("content", 256)).withColumn("language", F.lit("python"))
    facts = fa.extract_facts(files).cache()
    place = files.select("file_id", "language", "source_hash")
    symbols = fa.symbols(facts).join(place, "file_id").cache()
    imports = fa.imports(facts).cache()
    calls = resolve.resolve_calls(resolve.with_caller_ids(fa.calls(facts), symbols), symbols, imports).join(place, "file_id").cache()
    chunks = ck.text_chunks(files).withColumn("chunk_id", F.col("file_id") * 1000 + F.col("start_line")).cache()
    return preflight.Corpus(files, symbols, calls, chunks, imports)


def test_an_imported_name_is_exact(spark):
    tree = {"a.py": "def foo():\n    return 1\n", "z.py": "def foo():\n    return 2\n", "consumer.py": "from z import foo\n\ndef use():\n    return foo()\n"}
    stored = _indexed(spark, {"p": tree})
    asked = spark.createDataFrame([(1, "p", "where is foo", "consumer.py", 4), (2, "p", "where is foo", "a.py", None)], "request_id long, project_id string, question string, current_file string, line int")
    rows, _ = preflight.gather(asked, stored)
    found = rows.collect()
    assert [r.path for r in found if r.request_id == 1 and r.resolution == "exact" and r.symbol == "foo"] == ["z.py"]
    assert {r.path for r in found if r.request_id == 2 and r.resolution == "ambiguous_candidate"} == {"a.py", "z.py"}
    assert [(r.path, r.symbol) for r in found if r.request_id == 1 and r.resolution == "enclosing"] == [("consumer.py", "use")]


def test_equal_trees_of_two_projects_do_not_meet(spark):
    tree = {"main.py": "import os\nfrom lib import load\n\ndef main():\n    return load()\n", "lib.py": "def load():\n    return 1\n"}
    other = {"main.py": "import secret_b\nfrom lib import load\n\ndef main():\n    return load()\n", "lib.py": "def load():\n    return 2\n"}
    stored = _indexed(spark, {"A": tree, "B": other})
    asked = spark.createDataFrame([(1, "A", "callers of load", "main.py"), (2, "B", "callers of load", "main.py")], "request_id long, project_id string, question string, current_file string")
    project_of = {r.symbol_id: r.project_id for r in stored.symbols.collect()}
    names = asked.select("request_id", "project_id", F.lit("load").alias("name"), "current_file")
    for r in lookup.definitions(names, stored.symbols, 20, ["request_id"]).collect():
        assert project_of[r.symbol_id] == {1: "A", 2: "B"}[r.request_id]
    keys = lookup.asked_names(names)
    for relation in ("caller", "callee"):
        for r in lookup.neighbours(names, lookup.neighbour_heads(stored.calls, stored.symbols, relation, 9, keys), 9).collect():
            assert project_of[r.symbol_id] == {1: "A", 2: "B"}[r.request_id]
    heads = lookup.reference_heads(stored.calls, stored.symbols, 20, keys)
    got = lookup.references(names, heads, 10, ["request_id"]).collect()
    assert sorted((r.request_id, r.project_id) for r in got) == [(1, "A"), (2, "B")]
    chunk_project = {r.chunk_id: r.project_id for r in stored.chunks.collect()}
    hits = search.search_text(asked, stored.chunks, 20).collect()
    assert hits and all(chunk_project[r.chunk_id] == {1: "A", 2: "B"}[r.request_id] for r in hits)
    rows, _ = preflight.gather(asked, stored)
    hashes = {(r.project_id, r.path): r.source_hash for r in stored.files.collect()}
    assert all(r.source_hash == hashes[{1: "A", 2: "B"}[r.request_id], r.path] for r in rows.collect())
    imports = stored.imports.select("project_id", "path", F.col("target_module").alias("module"))
    maps = {r.project_id: r.map for r in repo_map.repository_map(stored.files, stored.symbols, imports, 2000).collect()}
    assert "secret_b" not in maps["A"] and "secret_b" in maps["B"]
    # A full list of one project never crowds out another's.
    many = spark.createDataFrame([("B", 10_000 + i, "needle here", f"f{i}.py", 1) for i in range(60)] + [("A", 1, "a needle", "z.py", 1)], "project_id string, chunk_id long, content string, path string, start_line int")
    few = spark.createDataFrame([(1, "A", "needle")], "request_id long, project_id string, question string")
    assert [r.chunk_id for r in search.search_text(few, many, 20).collect()] == [1]
