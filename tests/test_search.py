import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.operators import lookup, search

TEXTS = [
    "def load_user(name): return fetch_user(name)", "Café déjà vu: fetch the user", "user user user fetch", "straße ähnlich über",
    "load user from disk", "the load_user helper calls load_user twice", "nothing here", "fetch_user and load user", "数据库 迁移 migration",
]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("p", i + 1, f"f{i}.py", 1, text) for i, text in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "project_id string, chunk_id long, path string, start_line int, content string")


@pytest.mark.parametrize("question", ["load_user", "cafe deja", "user fetch", "load_user user the", "user user fetch", "missing"])
def test_bm25_equals_sqlite(spark, chunks, question):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(content, tokenize='unicode61')")
    con.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", list(enumerate(TEXTS, 1)))
    match = " OR ".join(f'"{term}"' for term in question.split())
    expected = {i: round(s, 6) for i, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    asked = spark.createDataFrame([(1, "p", question)], "request_id long, project_id string, question string")
    found = {r.chunk_id: round(r.bm25_score, 6) for r in search.bm25_search(asked, chunks, 50).collect()}
    assert found == expected


def test_literal_fallback_equals_like(spark, chunks):
    questions = ["load_user", "迁移", "ETCH", "r_u ser", "zzz"]
    asked = spark.createDataFrame([(n, "p", q) for n, q in enumerate(questions)], "request_id long, project_id string, question string")
    found = {}
    for row in search.literal_search(asked, chunks, 3).orderBy("request_id", "rank").collect():
        found.setdefault(row.request_id, []).append(row.chunk_id)
    for number, question in enumerate(questions):
        terms = asked.filter(F.col("request_id") == number).select(tx.literal_terms(F.col("question"))).first()[0]
        expected = [i + 1 for i, t in enumerate(TEXTS) if any(term.lower() in t.lower() for term in terms)][:3]
        assert found.get(number, []) == expected, question


def test_substring_join_equals_brute_force(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abc_") for _ in range(rng.randint(1, 7))) for _ in range(150)})
    needles = sorted({"".join(rng.choice("abc_") for _ in range(rng.randint(1, 4))) for _ in range(40)})
    left = spark.createDataFrame([(n,) for n in needles], "needle string")
    right = spark.createDataFrame([(w,) for w in words], "word string")
    found = {tuple(r) for r in lookup.containing(left, right, "needle", "word").collect()}
    assert found == {(n, w) for n in needles for w in words if n in w}


def test_lines_follow_splitlines(spark):
    samples = ["", "a", "a\n", "a\n\n", "a\r\nb\rc\x0bd\x0ce\u2028f\x85g", "\n", "é\nb\n"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    found = {r.i: r.l for r in rows.select("i", tx.lines_of(F.col("s")).alias("l")).collect()}
    assert found == {i: s.splitlines() for i, s in enumerate(samples)}


def test_identifier_at_cursor(spark):
    cases = [("foo_bar = 1", 3, "foo_bar"), ("foo_bar = 1", 8, "foo_bar"), ("a + 9x", 6, None), ("  x", 1, None), ("x", 99, "x"), ("", 1, None)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, line string, c int")
    found = {r.i: r.w for r in rows.select("i", tx.identifier_at(F.col("line"), F.col("c")).alias("w")).collect()}
    assert found == {i: want for i, (_, _, want) in enumerate(cases)}


def test_only_requests_with_too_few_ranked_hits_are_searched_for_literals(spark, chunks, monkeypatch):
    sought, plain = [], search.literal_search

    def literals(requests, *rest):
        sought.append({r.request_id for r in requests.collect()})
        return plain(requests, *rest)

    monkeypatch.setattr(search, "literal_search", literals)
    asked = spark.createDataFrame([(1, "p", "user"), (2, "p", "ETCH")], "request_id long, project_id string, question string")
    found = {(r.request_id, r["rank"]): r.chunk_id for r in search.search_text(asked, chunks, 2).collect()}
    assert sought == [{2}]
    assert sorted(found) == [(1, 1), (1, 2), (2, 1), (2, 2)] and (found[2, 1], found[2, 2]) == (1, 2)
    assert search.search_text(asked.filter("request_id = 1"), chunks, 2).count() == 2 and len(sought) == 1
