"""The stored index: exact answers, refreshes that equal a rebuild, versions that a pointer chooses."""

import random
import sqlite3
import uuid

import pytest
from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.operators import chunks as ck
from codequarry.operators import facts, refresh, search, text_index
from codequarry.sources.store import FactStore, build_facts, refresh_facts

CHUNK = "project_id string, path string, chunk_id long, start_line int, content string"
ASKED = "request_id long, project_id string, question string"
WORDS = ["the", "user", "load", "fetch", "name", "café", "Déjà", "load_user", "x1", "データ", "迁移", "straße", "of", "rare_word"]


def corpus(seed, n):
    """Chunks of which nearly all hold the common words, so that their idf is the floor."""
    rng = random.Random(seed)
    texts = [" ".join(["the", "of"] * rng.randint(0, 3) + rng.choices(WORDS, [9, 5, 3, 3, 2, 1, 1, 2, 1, 1, 1, 1, 9, 0.2], k=rng.randint(1, 40))) for _ in range(n)]
    return [(f"p{i % 3}", f"f{i // 4:03d}.py", i + 1, 1 + 70 * (i % 4), text) for i, text in enumerate(texts)]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = corpus(4, 240)
    chunks = spark.createDataFrame(rows, CHUNK)
    store = FactStore(spark, str(tmp_path_factory.mktemp("index")), "one", 2, text_index.ORDERS)
    text_index.build(store, chunks)
    return rows, chunks, text_index.opened(FactStore.current(spark, store.base, 2, text_index.ORDERS))


QUESTIONS = ["the of", "the user of rare_word", "load_user café", "deja the", "fetch the user", "user user load", "missing", "rare_word", "strasse straße", "データ the"]


@pytest.mark.parametrize("limit", [3, 20, 500])
def test_index_equals_sqlite(spark, built, limit):
    rows, chunks, index = built
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(content, tokenize='unicode61')")
    con.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", [(row[2], row[4]) for row in rows])
    asked = spark.createDataFrame([(i, "p1", q) for i, q in enumerate(QUESTIONS)], ASKED)
    found = {}
    for row in search.indexed_search(asked, index, limit).orderBy("request_id", "rank").collect():
        found.setdefault(row.request_id, []).append((row.chunk_id, round(row.bm25_score, 6)))
    project = {row[2]: row[0] for row in rows}
    for i, question in enumerate(QUESTIONS):
        match = " OR ".join(f'"{term}"' for term in question.split())
        scores = [(n, round(s, 9)) for n, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,)) if project[n] == "p1"]
        expected = [(n, round(s, 6)) for n, s in sorted(scores, key=lambda x: (x[1], x[0]))[:limit]]
        assert [s for _, s in found.get(i, [])] == pytest.approx([s for _, s in expected], abs=2e-6), question
        assert dict(found.get(i, [])).keys() == dict(expected).keys() or limit == 3, question


def test_index_equals_the_pass_over_texts(spark, built):
    _, chunks, index = built
    asked = spark.createDataFrame([(i, f"p{i % 4}", q) for i, q in enumerate([*QUESTIONS, "a", "e r", "迁移", "ETCH zzz", "r_u ser", "", "é", "loaded"])], ASKED)
    for limit in (1, 4, 90):
        want = sorted(tuple(r) for r in search.search_text(asked, chunks, limit).collect())
        got = sorted(tuple(r) for r in search.search_text(asked, index, limit).collect())
        assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
        assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-8)


def test_search_reads_no_text(spark, built):
    _, _, index = built
    asked = spark.createDataFrame([(1, "p1", "the user")], ASKED)
    plan = search.indexed_counts(index, search.request_phrases(asked))._jdf.queryExecution().toString()
    assert "content" not in plan and "postings" in plan


FILES = "project_id string, path string, size long, mtime_ns long, content string"


def listing(spark, files):
    return spark.createDataFrame([(p, f, len(c.encode()), t, c) for (p, f), (t, c) in sorted(files.items())], FILES).withColumn("language", F.lit("python"))


def chunked(files):
    """Chunks with an id that follows from place and file."""
    rows = files.withColumn("lines", tx.lines_of(F.col("content"))).withColumn("line_count", F.size("lines"))
    return ck.text_chunks(rows).withColumn("chunk_id", F.xxhash64("project_id", "path", "start_line"))


def code(rng, i):
    calls = "\n".join(f"    {rng.choice('abcde')}_{rng.randint(0, 5)}(x)" for _ in range(rng.randint(1, 4)))
    return f"import os\nfrom m{rng.randint(0, 9)} import a_{i % 6}\n\ndef {rng.choice('abcde')}_{i}(x):\n{calls}\n\nclass C{i}:\n    pass\n"


def python_facts(rows_of):
    """One table of a file's facts; keys are the file's, whichever files come with it."""

    def derive(files):
        # 32 bits leave room for the fact's number.
        named = files.withColumn("file_id", F.crc32(F.concat("project_id", F.lit("/"), "path"))).withColumn("module", F.regexp_replace("path", r"\.py$", ""))
        return rows_of(facts.extract_facts(named))

    return derive


def test_refresh_equals_a_rebuild(spark, tmp_path):
    """Every table, after files were edited, touched, removed and added, is what a build of the new files gives."""
    rng = random.Random(12)
    files = {(f"p{i % 2}", f"d{i % 3}/m{i}.py"): (1, code(rng, i)) for i in range(24)}
    derive = text_index.derived(chunked) | {name: python_facts(getattr(facts, name)) for name in ("symbols", "imports", "calls")}
    hash_of = F.sha2("content", 256)
    store = FactStore(spark, str(tmp_path / "store"), "a", 3, text_index.ORDERS)
    build_facts(store, listing(spark, files).withColumn("source_hash", hash_of), derive)
    store.extend("run_grams", text_index.grams_of(store.read("runs").select(F.col("run").alias("word")).distinct()))
    for turn in (2, 3):
        for key in rng.sample(sorted(files), 5):
            kind = rng.choice(("edit", "touch", "remove"))
            if kind == "remove":
                del files[key]
            else:
                files[key] = (turn, files[key][1] if kind == "touch" else code(rng, 100 * turn + len(key[1])))
        files[(f"p{turn}", f"new{turn}.py")] = (turn, code(rng, 50 + turn))
        actions = {r.action for r in refresh_facts(store, listing(spark, files), hash_of, derive).collect()}
        assert "added" in actions and "reused" in actions
    text_index.learn_runs(store)
    fresh = FactStore(spark, str(tmp_path / "fresh"), uuid.uuid4().hex, 5, text_index.ORDERS)
    build_facts(fresh, listing(spark, files).withColumn("source_hash", hash_of), derive)
    for table in ("files", *derive):
        columns = sorted(fresh.read(table).columns)
        want, got = ([tuple(map(str, r)) for r in s.read(table).select(*columns).collect()] for s in (fresh, store))
        assert sorted(want) == sorted(got) and want, table
    # Grams that no chunk holds any more may stay; every run has its own.
    runs = store.read("runs").select(F.col("run").alias("word")).distinct()
    assert text_index.grams_of(runs).join(store.whole("run_grams"), ["gram", "word"], "left_anti").isEmpty()
    marks = store.whole("run_grams").filter("gram = ''")
    assert marks.count() == marks.distinct().count()


def test_pointer_chooses_the_version(spark, tmp_path):
    base = str(tmp_path / "store")
    assert FactStore.current(spark, base) is None
    rows = spark.createDataFrame([("p", "a.py", 1)], "project_id string, path string, n int")
    one, two = FactStore(spark, base, "one"), FactStore(spark, base, "two")
    one.create("facts", rows)
    assert FactStore.current(spark, base) is None
    one.publish()
    two.create("facts", rows.withColumn("n", F.lit(2)))
    # Built aside: readers see it when it is published.
    assert FactStore.current(spark, base).read("facts").first()["n"] == 1
    two.publish()
    assert FactStore.current(spark, base).read("facts").first()["n"] == 2
    one.publish()
    assert FactStore.current(spark, base).version == "one"


def test_status_counts_parse_errors(spark, tmp_path):
    """The table of errors is replaced with its files like any other; the status counts what it holds."""
    derive = {"errors": python_facts(facts.parse_errors)}
    files = {("p", "a.py"): (1, "def f(:\n"), ("p", "b.py"): (1, "x = 1\n"), ("q", "c.py"): (1, "y = 1\n")}
    store = FactStore(spark, str(tmp_path / "store"), "a", 2)
    hash_of = F.sha2("content", 256)
    build_facts(store, listing(spark, files).withColumn("source_hash", hash_of), derive)
    files |= {("p", "a.py"): (2, "def f():\n    pass\n"), ("p", "b.py"): (2, "x = (\n"), ("p", "d.py"): (2, "class\n")}
    actions = refresh_facts(store, listing(spark, files), hash_of, derive)
    status = refresh.with_parse_errors(refresh.refresh_summary(actions), store.read("errors"))
    assert {r.project_id: (r.updated_files, r.added_files, r.parse_error_files) for r in status.collect()} == {"p": (2, 1, 2), "q": (0, 0, 0)}
