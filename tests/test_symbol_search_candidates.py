"""symbol_search asks for every word of a question, however many it has."""

import __spark_entry__ as entry


def test_words_beyond_the_twelfth_are_asked(spark, tmp_path):
    words = [f"name{chr(97 + i)}" for i in range(15)]
    documents = [(1, "nameo defined here\nnamen too", "en", "src0", 28), (2, "namea first", "en", "src0", 11)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = entry.queries()["symbol_search"](spark, str(tmp_path)).filter("match = 'exact'").select("request_id", "name").collect()
    assert {(r.request_id, r.name) for r in found} == {("3:0", "namea"), ("3:13", "namen"), ("3:14", "nameo")}
