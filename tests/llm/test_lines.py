"""Line dedup against SQL and by hand."""

from songloom.llm.lines import drop_shared_lines
from songloom.llm.registered import QUERIES, SQL
from songloom.llm.runs import SortedRuns
from tests.conftest import SMALL
from tools.check import compare, connect


def test_query_against_sql(spark):
    for name in ("op4_shared_lines",):
        ok, note = compare(spark, connect(SMALL), SMALL, QUERIES[name], SQL[name])
        assert ok, note


def test_runs_count_over_batches_and_levels(spark):
    runs = SortedRuns(spark, 3, 2)
    batches = [["a", "b", "a"], ["a", "c"], ["b", "d"], [], ["c", "b", "e", "a"]]
    for batch in batches:
        runs.add(spark.createDataFrame([(x.encode(),) for x in batch], "key binary"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted(bytes(r[0]).decode() for r in runs.frequent().collect()) == ["a", "b"]
    names = [n for level in runs.levels for n in level]
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_odd_rows(spark):
    long = "\n".join(f"line {i}" for i in range(30_000)) + "\nShared"
    texts = [None, "", " shared\t\nown 1", "SHARED \nown 2\n", "shared\r\nshared\nÉ\n\n", long, "é\nÉ", "same\nrow", "same\nrow"]
    docs = spark.createDataFrame([(None if i == 3 else i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, lines int")
    got = sorted((r["lines"]["n_lines"], r["lines"]["n_dropped"], r["lines"]["kept"]) for r in drop_shared_lines(docs, min_docs=3).collect())
    want = sorted([
        (1, 0, ""), (1, 0, ""), (2, 1, "own 1"), (3, 1, "own 2\n"), (5, 2, "É\n\n"),
        (30_001, 1, long.removesuffix("\nShared")), (2, 0, "é\nÉ"), (2, 0, "same\nrow"), (2, 0, "same\nrow"),
    ])
    assert got == want
    longer = drop_shared_lines(docs, min_docs=2, min_chars=5).where("doc_id = 7").first()["lines"]
    assert (longer["kept"], longer["n_dropped"]) == ("same\nrow", 0)
    assert drop_shared_lines(docs.limit(0)).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    """Twelve rows of an id don't make its line a shared one; rows without an id are documents of their own."""
    docs = spark.createDataFrame(
        [(1, "mine\nboth")] * 12 + [(i, "both") for i in range(2, 4)] + [(None, "none\nboth")] * 3, "doc_id long, text string"
    )
    kept = {(r["doc_id"], r["lines"]["kept"]) for r in drop_shared_lines(docs, min_docs=3).collect()}
    assert kept == {(1, "mine"), (2, ""), (3, ""), (None, "")}
    assert {r["lines"]["kept"] for r in drop_shared_lines(docs.where("doc_id = 1"), min_docs=2).collect()} == {"mine\nboth"}
