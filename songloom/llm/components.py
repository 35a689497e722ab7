"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from songloom.session import materialized

MAX_ROUNDS = 200


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction: the neighbours of each node are linked to the least of them instead.

    ``links`` has each pair once, ``a > b``. The large star moves neighbours above
    the node, the small star those below and the node itself. The least neighbour
    is a mergeable aggregate and joined back, so no node's neighbours meet in a task.
    """
    if large:
        pairs = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = pairs.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
        moved = pairs.join(least, F.col("u") == F.col("_u")).where(F.col("v") > F.col("u"))
        new = moved.select(F.col("v").alias("a"), F.least("_m", "u").alias("b"))
    else:
        least = links.groupBy(F.col("a").alias("_u")).agg(F.min("b").alias("_m"))
        moved = links.join(least, F.col("a") == F.col("_u"))
        new = moved.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(
            least.select(F.col("_u").alias("a"), F.col("_m").alias("b"))
        )
    return new.where(F.col("a") > F.col("b")).distinct()


def _digest(links: DataFrame) -> tuple:
    """Number of links and two order-free sums over them: equal only if nothing moved."""
    return tuple(links.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))
    ).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a long, b long)``; the component is its least node.

    Direction, repeated links and self links don't matter, nulls are ignored. The
    number of rounds grows with the logarithm of the longest chain. Every round is
    written to the shared folder, which also cuts the lineage.
    """
    ordered = (
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    current = materialized(ordered, "links")
    before = _digest(current)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        current = materialized(_star(_star(current, True), False), "links")
        now = _digest(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
    # settled: every node is linked to the least of its component and nothing else
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
