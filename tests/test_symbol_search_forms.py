"""symbol_search asks every candidate whole and as far as it was typed."""

import __spark_entry__ as entry


def test_candidates_are_asked_whole_and_begun(spark):
    asked = {r.request_id for r in entry.queries()["symbol_search"](spark, "/root/testdata/sf0.001").select("request_id").distinct().collect()}
    begun = {key for key in asked if key.endswith(":typed")}
    assert begun and asked - begun
