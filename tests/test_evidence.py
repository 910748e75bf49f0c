"""Packing, intervals, streams, the tree reader and the store."""

import random
import re
import time
from pathlib import Path

from pyspark.sql import functions as F

from codequarry.operators import evidence as ev
from codequarry.operators import graph, intervals, packing, sessions
from codequarry.sources import code_tree
from codequarry.sources.event_log import parse
from codequarry.sources.store import FactStore, refresh_facts
from codequarry.streaming import runs, state

ITEM = "request_id long, ord int, path string, start_line int, end_line int, content string, relation string, symbol string, score double"


def test_packing_skips_what_does_not_fit(spark):
    rows = [(1, 0, "a.py", 1, 1, "x" * 300, "definition", "f", 1.0), (1, 1, "b.py", 1, 1, "y" * 9000, "definition", "g", 0.9),
            (1, 2, "c.py", 1, 1, "z" * 60, "text", None, 0.1)]
    packed = packing.pack(spark.createDataFrame(rows, ITEM), 300, 50, 50, 0).first()
    assert packed.kept == [0, 2] and packed.omitted == [1] and packed.evidence_tokens <= packed.available_tokens == 200
    spent = packing.pack(spark.createDataFrame(rows, ITEM), 100, 80, 40, 0).first()
    assert spent.kept == [] and spent.available_tokens == 0 and "预留" in spent.warning


def test_packing_never_exceeds_the_window(spark):
    rng = random.Random(5)
    rows = [(r, i, f"p{i}.py", 1, 1, "w" * rng.randint(1, 4000), rng.choice(["definition", "text", "caller"]), None, rng.random())
            for r in range(20) for i in range(rng.randint(1, 12))]
    for window in (256, 1024, 4096):
        for row in packing.pack(spark.createDataFrame(rows, ITEM), window, 100, 60, 0).collect():
            assert row.used_tokens <= window
            assert not row.kept or len(row.text) // 3 <= row.available_tokens


def plain_packing(rows, window, reserves, counter):
    """Blocks in order, each kept if the text with it still fits."""
    tiers = ["definition", "reference", "caller", "callee", "text"]
    blocks, kept, left_out = [], [], []
    available = max(0, window - reserves)
    for row in sorted(rows, key=lambda r: (tiers.index(r[6]), -r[8], r[2].lower(), r[3], r[1])):
        block = f"[{row[6]}] {row[2]}:{row[3]}-{row[4]}" + (f" · {row[7]}" if row[7] else "") + f"\n{row[5]}"
        if counter("\n\n".join([*blocks, block])) <= available:
            blocks.append(block)
            kept.append(row[1])
        else:
            left_out.append(row[1])
    return kept, left_out, "\n\n".join(blocks), min(available, counter("\n\n".join(blocks)))


def test_packing_by_either_counter_equals_the_plain_rule(spark):
    rng = random.Random(8)
    words = ["def", "load", "user_name", "é", "数据", "()", "x", "\n"]
    rows = [(r, i, f"p{i % 4}.py", i + 1, i + 2, " ".join(rng.choices(words, k=rng.randint(0, 90))),
             rng.choice(["definition", "reference", "caller", "callee", "text"]), rng.choice([None, "s"]), rng.random())
            for r in range(12) for i in range(rng.randint(1, 14))]
    frame = spark.createDataFrame(rows, ITEM)
    # Counts of joined texts aren't sums: neighbours merge, as with real tokenizers.
    by_words = lambda text: len(re.findall(r"\w+|[^\w\s]", text)) - text.count("x x") // 2
    by_length = lambda text: max(1, len(text) // 3)
    for window in (40, 130, 400):
        for counter, plain in ((by_words, by_words), (None, by_length)):
            for got in packing.pack(frame, window, 10, 15, 5, counter=counter).collect():
                want = plain_packing([r for r in rows if r[0] == got.request_id], window, 30, plain)
                assert (got.kept, got.omitted, got.text) == want[:3]
                assert got.evidence_tokens == want[3] and got.used_tokens == min(window, 30 + want[3])


def test_long_spans_become_fragments(spark):
    content = "\n".join(str(i) for i in range(250))
    rows = [(1, 0, "a.py", 11, 260, content, "definition", "f", 0.9), (1, 1, "b.py", 1, 300, "short", "text", None, 0.5)]
    found = packing.fragments(spark.createDataFrame(rows, ITEM)).orderBy("ord", "start_line").collect()
    assert [(r.start_line, r.end_line) for r in found] == [(11, 110), (111, 210), (211, 260), (1, 300)]
    assert [round(r.score, 3) for r in found] == [0.9, 0.898, 0.896, 0.5]


def test_overlap_join_equals_brute_force(spark):
    rng = random.Random(11)
    spans = lambda n: [(rng.randint(0, 2), i, s := rng.randint(1, 400), s + rng.randint(0, 150)) for i in range(n)]
    left, right = spans(60), spans(60)
    a = spark.createDataFrame(left, "k int, l int, left_start int, left_end int")
    b = spark.createDataFrame(right, "k int, r int, right_start int, right_end int")
    found = sorted((x.l, x.r) for x in intervals.overlap_join(a, b, ["k"]).collect())
    assert found == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])


def test_reach_gives_shortest_depths(spark):
    rng = random.Random(2)
    pairs = {(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(60)}
    edges = spark.createDataFrame(sorted(pairs), "src int, dst int")
    seeds = spark.createDataFrame([(n, n) for n in range(31)], "request_id int, node int")
    found = {(r.request_id, r.node): r.depth for r in graph.reach(edges, seeds, 3).collect()}
    expected = {}
    for start in range(31):
        seen, layer = {start}, {start}
        for depth in (1, 2, 3):
            layer = {d for s, d in pairs if s in layer} - seen
            seen |= layer
            expected.update({(start, n): depth for n in layer})
    assert found == expected


def test_citations_across_fragments(spark):
    assert state.feed("", "依据 [E", {"E1"}) == ("依据 ", "[E", [])
    out, held, unknown = state.feed("[E", "1] 可知，另见 [E", {"E1"})
    assert (out, held) == ("[E1] 可知，另见 ", "[E")
    assert state.feed(held, "9]。", {"E1"}) == ("。", "", ["E9"])
    whole = spark.createDataFrame([("依据 [E1] 可知，另见 [E9]。[x] [E7", )], "t string").select(
        ev.filter_citations(F.col("t"), F.array(F.lit("E1"))).alias("r")
    ).first().r
    assert (whole.text, whole.invalid) == ("依据 [E1] 可知，另见 。[x] [E7", ["E9"])


ENV = "event_id long, request_id string, arrived timestamp, job_id string, seq int, type string, text string"


def test_gate_batch_and_stream_agree(spark, tmp_path):
    from datetime import datetime, timedelta

    rng = random.Random(9)
    rows = [
        # A third of all envelopes belongs to one request.
        (i, "hot" if i % 3 == 0 else f"r{rng.randint(0, 20)}", datetime(2024, 1, 1) + timedelta(minutes=i), f"j{rng.randint(0, 1)}",
         i // 4 + rng.randint(-30, 30), "complete" if rng.random() < 0.01 else "delta", "t") for i in range(1500)
    ]
    frame = spark.createDataFrame(rows, ENV)
    expected, states = [], {}
    for row in rows:
        job, last, done = states.get(row[1], (row[3], -1, False))
        if not done and row[3] == job and row[4] > last:
            expected.append(row[0])
            last, done = row[4], row[5] == "complete"
        states[row[1]] = (job, last, done)
    assert sorted(r.event_id for r in sessions.envelope_gate(frame).collect()) == expected
    source = str(tmp_path / "env")
    for part in range(3):
        frame.filter((F.col("event_id") >= part * 500) & (F.col("event_id") < part * 500 + 500)).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    assert sorted(r.event_id for r in runs.drain(state.gate_stream(stream)).collect()) == expected


def test_anchor_stream_keeps_the_newest(spark, tmp_path):
    columns = "conversation_id long, ord long, path string, start_line int, end_line int, source_hash string, symbol string"
    rows = [(1, i, f"a\\f{i % 20}.py" if i != 7 else "", 1, 2, f"h{i}", "s") for i in range(50)]
    frame = spark.createDataFrame(rows, columns)
    batch = sorted((r.path, r.ord) for r in sessions.merge_anchors(frame).collect())
    frame.coalesce(1).write.parquet(str(tmp_path / "anchors"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "anchors"))
    found = sorted((r.path, r.ord) for r in runs.drain(state.anchor_stream(stream)).collect())
    assert found == batch and len(found) == 16


def test_event_log_streams(spark, tmp_path):
    good = 'event: delta\\ndata: {"job_id":"j","seq":0,"type":"delta","scope_id":"f","payload":{"text":"a","target":"t"}}'
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text(good + "\n" + good.replace('"seq":0', '"seq":-1') + "\nnoise\n")
    lines = spark.readStream.text(str(tmp_path / "log")).select(F.replace("value", F.lit("\\n"), F.lit("\n")).alias("value"))
    problems = sorted(r.problem or "" for r in runs.drain(parse(lines).select("problem")).collect())
    assert problems == ["", "bad_seq", "malformed"]


def write(root: Path, files: dict) -> None:
    for name, body in files.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body if isinstance(body, bytes) else body.encode())


def test_tree_scan(spark, tmp_path):
    write(tmp_path, {
        "pkg/__init__.py": "x = 1\n", ".gitignore": "secret/\n!secret/keep.py\n*.log\n/top.py\n", "secret/a.py": "no", "secret/keep.py": "yes = 1\n",
        "run.log": "no", "top.py": "no", "sub/top.py": "ok", "README": "hello", "node_modules/x.js": "no", "cn.txt": "数据".encode("gb18030"),
        "bin.txt": b"a\x00b", "big.txt": "x" * 3000, "photo.png": b"\x89PNG", "bom.md": b"\xef\xbb\xbf# t\n",
    })
    from codequarry.options import Options

    roots = spark.createDataFrame([("p", str(tmp_path))], "project_id string, root string")
    rows = {r.path: r for r in code_tree.scan_tree(spark, roots, Options(max_file_bytes=2000)).collect()}
    assert set(rows) == {"pkg/__init__.py", "secret/keep.py", "sub/top.py", "README", "cn.txt", "bin.txt", "big.txt", "bom.md"}
    assert rows["cn.txt"].content == "数据" and rows["bom.md"].content == "# t\n"
    assert (rows["bin.txt"].problem, rows["big.txt"].problem, rows["README"].language) == ("binary", "too_large", "plaintext")


def test_store_follows_a_feed(spark, tmp_path):
    columns = "project_id string, path string, size long, mtime_ns long, content string"
    first = [("p", f"f{i}.py", 4, 1, f"v{i:03d}") for i in range(12)]
    store = FactStore(spark, str(tmp_path / "store"), buckets=4)
    store.create("files", spark.createDataFrame(first, columns).withColumn("source_hash", F.sha2("content", 256)))
    edited = [("p", "f1.py", 4, 2, "new!"), ("p", "f2.py", 4, 2, "v002"), ("p", "g.py", 3, 2, "add")]
    spark.createDataFrame(edited, columns).coalesce(1).write.parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(columns).parquet(str(tmp_path / "feed"))
    runs.refresh_from_feed(feed, store, F.sha2("content", 256), str(tmp_path / "cp")).awaitTermination()
    now = {r.path: r.content for r in store.read("files").collect()}
    assert len(now) == 13 and now["f1.py"] == "new!" and now["g.py"] == "add" and now["f3.py"] == "v003"
    listing = spark.createDataFrame([("p", "g.py", 3, 2, "add")], columns)
    actions = {r.path: r.action for r in refresh_facts(store, listing, F.sha2("content", 256)).collect()}
    assert actions.pop("g.py") == "reused" and set(actions.values()) == {"removed"}
    assert [r.path for r in store.read("files").collect()] == ["g.py"]
