"""Hexadecimal strings of any length are candidates."""

from songloom.llm.pii import candidates


def test_long_hexadecimal_strings(spark):
    runs = {i: ("0123456789abcdef" * 400)[:n] for i, n in enumerate((31, 32, 128, 129, 512, 6_000))}
    docs = spark.createDataFrame([(i, f"the key {x}, then") for i, x in runs.items()] + [(9, "x" + runs[4]), (10, runs[4] + "g")], "doc_id long, text string")
    found = candidates(docs).where("kind = 'secret'").select("doc_id", "value").collect()
    assert sorted(found) == [(i, x) for i, x in runs.items() if i]
