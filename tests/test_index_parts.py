"""The parts of the stored index: built apart, without shuffling what a text yields."""

import re

from pyspark.sql import functions as F

from codequarry.operators import search, text_index
from codequarry.operators.lookup import containing_in
from codequarry.sources.store import FactStore

CHUNK = "project_id string, path string, chunk_id long, start_line int, content string"
ROWS = [("p", "a", 1, 1, "the user the Load"), ("p", "a", 2, 71, ""), ("p", "b", 3, 1, None), ("q", "a", 4, 1, "Déjà_vu the the the"), ("q", "c", 5, 1, "--")]


def test_postings_follow_from_each_chunk_alone(spark):
    found = text_index.postings_of(spark.createDataFrame(ROWS, CHUNK))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.chunk_id, r.term, r.dl, r.tf, r.positions) for r in found.collect())
    want = []
    for _, _, chunk, _, text in ROWS:
        tokens = re.findall(r"[a-z]+", (text or "").lower().replace("é", "e").replace("à", "a"))
        want += [(chunk, t, len(tokens), tokens.count(t), [i for i, x in enumerate(tokens) if x == t]) for t in set(tokens)]
    assert got == sorted(want)


def test_a_part_is_built_alone(spark, tmp_path):
    chunks = spark.createDataFrame(ROWS, CHUNK)
    store = FactStore(spark, str(tmp_path / "terms"), "a", 2, text_index.ORDERS)
    text_index.build(store, chunks, ("terms",))
    assert {p.name for p in (tmp_path / "terms" / "va").iterdir()} == {"postings", "text_stats"}
    assert text_index.opened(store).postings.count() == 6


def test_chunks_given_twice_add_up(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "terms"), "a", 2, text_index.ORDERS)
    text_index.build(store, spark.createDataFrame([*ROWS, ROWS[0]], CHUNK), ("terms",))
    rows = store.read("postings").filter("chunk_id = 1 AND term = 'the'").select("dl", "tf", F.col("positions")).collect()
    assert [tuple(r) for r in rows] == [(4, 4, [0, 0, 2, 2])]


def test_few_needles_do_not_shuffle_the_stored_grams(spark, tmp_path):
    words = spark.createDataFrame([("load_user",), ("user",), ("other",)], "word string")
    text_index.grams_of(words).write.parquet(str(tmp_path / "grams"))
    needles = spark.createDataFrame([("use",), ("r",), ("zzz",)], "needle string")
    found = containing_in(needles, spark.read.parquet(str(tmp_path / "grams")), "needle", "word")
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [("r", "load_user"), ("r", "other"), ("r", "user"), ("use", "load_user"), ("use", "user")]


def test_literals_are_filled_round_by_round(spark, tmp_path, monkeypatch):
    """Frequent literals from the first chunks, others from more of them, rare ones from all."""
    monkeypatch.setattr(search, "DEEP", 12)
    rows = [("p", f"f{i:03d}", i, 1, " ".join(["all", *["some"] * (i % 5 == 4), *["rare"] * (i in (3, 77))])) for i in range(100)]
    chunks = spark.createDataFrame(rows, CHUNK)
    store = FactStore(spark, str(tmp_path / "index"), "a", 2, text_index.ORDERS)
    text_index.build(store, chunks)
    asked = spark.createDataFrame([(i, "p", q) for i, q in enumerate(("all", "some", "rare", "rare some", "gone"))], "request_id long, project_id string, question string")
    got = sorted(tuple(r) for r in search.indexed_literals(asked, text_index.opened(store), 2).collect())
    assert got == sorted(tuple(r) for r in search.literal_search(asked, chunks, 2).collect())
    assert [r[1] for r in got] == [0, 1, 4, 9, 3, 77, 3, 4]
