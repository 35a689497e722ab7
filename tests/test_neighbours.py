"""Exact neighbours by cells and pivots against full scans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from songloom.operators.neighbours import nearest_entries
from songloom.operators.pitch import retrieval_blend


def clustered(rng, n, centers, dims, width=0.05):
    return (centers[rng.integers(0, len(centers), n)] + rng.normal(0, width, (n, dims))).tolist()


def frames(spark, vectors, index):
    return (
        spark.createDataFrame(list(enumerate(vectors)), "vec_id long, _v array<double>"),
        spark.createDataFrame(index, "entry_id string, entry array<double>"),
    )


def full_scan(vector, index, k):
    """Distances and ids of the nearest entries; those of equal distance by id."""
    usable = [(i, e) for i, e in index if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    return sorted((math.dist(vector, e), i) for i, e in usable)[:k]


@pytest.mark.parametrize("k,cell_entries,cell_visits", [(1, 4096, 4096), (3, 5, 7), (200, 16, 64)])
def test_equals_full_scan(spark, k, cell_entries, cell_visits):
    """Crowded cells, repeated entries, ties, entries that can't be compared."""
    rng = np.random.default_rng(k)
    centers = rng.normal(0, 2, (9, 6))
    index = [(f"e{i:03}", e) for i, e in enumerate(clustered(rng, 150, centers, 6))]
    index += [(f"x{i}", index[0][1]) for i in range(20)] + [("null", None), ("nan", [math.nan] * 6), ("part", [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    vectors = clustered(rng, 60, centers, 6) + [index[0][1], [50.0] * 6, [0.0] * 6]
    df = nearest_entries(*frames(spark, vectors, index), k, cell_entries=cell_entries, cell_visits=cell_visits)
    got = {r.vec_id: r._best for r in df.collect()}
    assert len(got) == len(vectors)
    for i, v in enumerate(vectors):
        want = full_scan(v, index, k)
        assert [b.id for b in got[i]] == [e for _, e in want], i
        assert [b.d for b in got[i]] == pytest.approx([d for d, _ in want])


def test_clustered_data_compares_few(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 3, (60, 16))
    vectors, index = clustered(rng, 800, centers, 16), [(f"e{i}", e) for i, e in enumerate(clustered(rng, 3000, centers, 16))]
    df = nearest_entries(*frames(spark, vectors, index), 3)
    compared = df.agg(F.sum("_compared")).first()[0]
    assert compared < 0.2 * len(vectors) * len(index), compared / len(vectors) / len(index)


def test_edges(spark):
    vectors = spark.createDataFrame(
        [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [math.nan, 0.0]), (None, [0.0, 0.0])], "vec_id long, embedding array<float>"
    )
    index = spark.createDataFrame([(7, [1.0, 0.0]), (8, [1.0, 4.0])], "entry_id long, entry array<double>")
    got = sorted((r.vec_id or 0, r.pos, r.value) for r in retrieval_blend(vectors, index, rate=1.0, k=5).collect())
    assert got == sorted([(1, 0, 1.0), (1, 1, 2.0)] * 2 + [(0, 0, 1.0), (0, 1, 2.0)])
    alone = sorted((r.vec_id or 0, r.pos, r.value) for r in retrieval_blend(vectors, index.limit(0)).collect())
    assert alone == sorted([(1, 0, 1.0), (1, 1, 2.0)] * 2 + [(0, 0, 0.0), (0, 1, 0.0)])
    assert retrieval_blend(vectors.limit(0), index).count() == 0
