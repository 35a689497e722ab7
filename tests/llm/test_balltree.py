"""Exact search against SQL and brute force."""

import math
import random

import pytest

from songloom.llm import balltree
from songloom.llm.balltree import integer_vectors, nearest_by_inner_product
from songloom.llm.registered import QUERIES, SQL
from tests.conftest import SMALL
from tools.check import compare, connect


def plain(rows, queries, k):
    """Rows of (query_id, rank, vec_id, score) by scoring everything."""
    good = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, v in sorted(good):
        if queries(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in good if c != q and len(w) == len(v))
            out += [(q, n, c, -s) for n, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, rows, queries, k, **sizes):
    vectors = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    asked = vectors.where(queries)
    return sorted(tuple(r) for r in nearest_by_inner_product(vectors, asked, k, **sizes).collect())


def test_query_against_sql(spark):
    ok, note = compare(spark, connect(SMALL), SMALL, QUERIES["op9_ball_tree"], SQL["op9_ball_tree"])
    assert ok, note


def test_many_ties_and_shards(spark):
    rng = random.Random(9)
    common = [0.25, -0.5, 0.125]
    rows = [(i, common if i % 3 == 0 else [rng.choice([-1, 0, 0.5, 1]) / 2 for _ in range(3)]) for i in rng.sample(range(5_000), 900)]
    for sizes in ({}, {"shard_rows": 150, "block_rows": 20}):
        assert found(spark, rows, "vec_id % 7 = 0", 4, **sizes) == plain(rows, lambda q: q % 7 == 0, 4)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, [1.0, None]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (5, [0.5, -0.001]), (6, [0.5, 0.5]),
        (6, [0.5, 0.5]), (7, [-1.0, 2.0]), (8, [1.0]), (9, []), (10, []), (None, [1.0, 1.0]), (11, [0.0, 0.0]),
    ]
    assert found(spark, rows, "true", 5) == plain(rows, lambda q: True, 5)
    assert found(spark, rows[:1], "true", 5) == []
    with pytest.raises(ValueError):
        found(spark, [(1, [1e12]), (2, [1e12])], "true", 5)


def test_empty_table_and_clashing_columns(spark):
    empty = integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert nearest_by_inner_product(empty, empty, 5).count() == 0
    rows = [(i, [i / 8, 1.0], i, "x", 0) for i in range(9)]
    vectors = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score long, query_id string, rank int"))
    got = sorted(tuple(r) for r in nearest_by_inner_product(vectors, vectors.where("vec_id = 3"), 2).collect())
    assert [g[:3] for g in got] == [(3, 1, 8), (3, 2, 7)]


def test_clustered_vectors_skip_shards(spark, monkeypatch):
    """Shards and blocks of near vectors: most pairs of them are dropped by their root balls."""
    rng = random.Random(2)
    centers = [[rng.choice([-6, 0, 6]) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + rng.uniform(-0.1, 0.1) for c in rng.choice(centers)]) for i in range(2_400)]
    tables, kept = {}, balltree.materialized
    monkeypatch.setattr(balltree, "materialized", lambda df, name: tables.setdefault(name, kept(df, name)) if name != "cells" else kept(df, name))
    got = found(spark, rows, "vec_id % 5 = 0", 3, shard_rows=50, block_rows=16)
    assert got == plain(rows, lambda q: q % 5 == 0, 3)
    pairs = tables["ball-trees"].count() * tables["query-blocks"].count()
    assert tables["reached-shards"].count() < 0.5 * pairs, (tables["reached-shards"].count(), pairs)
