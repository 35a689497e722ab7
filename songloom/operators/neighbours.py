"""Exact nearest entries of an index, by cells around pivots and the triangle inequality.

A bounded number of entries serve as pivots. Every entry belongs to the cell of
its nearest pivot. A vector knows its distance to all pivots, hence for every
cell a bound below the distance of whatever lies in it. It visits cells in order
of that bound, two, then eight and so on at a time, and stops when the next bound
exceeds the k-th distance it has. Inside a cell only entries whose distance to the pivot
differs by no more than that are compared.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from songloom.session import materialized

# Most pivots; they travel to the driver and to every task.
PIVOTS = 1024
# Entries and visitors of a cell that meet in one group.
CELL_ENTRIES = 4096
CELL_VISITS = 4096
FIRST_VISITS = 2
# Relative slack of bounds, far above the rounding of a distance.
SLACK = 1e-9

BEST = "array<struct<d:double,id:{id},entry:array<double>>>"


def _stacked(rows: list) -> np.ndarray:
    return np.array(rows, dtype=np.float64).reshape(len(rows), -1)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every point to every pivot, a few points at a time."""
    out = np.empty((len(points), len(pivots)))
    for at in range(0, len(points), 64):
        out[at:at + 64] = np.sqrt(((points[at:at + 64, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))
    return out


def _usable(column: str):
    """Not null, and without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(column).isNotNull() & ~F.exists(column, bad)


class Pivots:
    """The pivots, and how far the entries of each cell lie from theirs."""

    def __init__(self, entries: DataFrame, most: int):
        n = entries.count()
        wanted = max(1, min(most, int(np.ceil(np.sqrt(n)))))
        chosen = entries.orderBy(F.xxhash64("entry_id"), "entry_id").limit(wanted).select("entry").toArrow()
        self.points = np.unique(_stacked(chosen["entry"].to_pylist()), axis=0) if len(chosen) else np.empty((0, 0))
        self.radius = np.zeros(len(self.points))

    def assign(self):
        points = self.points

        def cells(batches):
            for batch in batches:
                for at in range(0, len(batch), 2048):
                    part = batch.iloc[at:at + 2048]
                    far = _distances(_stacked(part["entry"].tolist()), points)
                    cell = far.argmin(axis=1)
                    yield part.assign(cell=cell.astype(np.int32), off=far[np.arange(len(part)), cell])

        return cells


def _order_of_visits(vectors: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of each vector by rising bound, the bounds, and the distances to all pivots; empty cells come last."""
    far = _distances(vectors, pivots)
    bound = np.where(radius < 0, np.inf, np.maximum(far - radius, 0))
    # of equal bounds the nearer pivot first
    order = np.lexsort((far, bound), axis=-1)
    return order, np.take_along_axis(bound, order, axis=1), far


def nearest_entries(
    vectors: DataFrame, index: DataFrame, k: int = 1, pivots: int = PIVOTS, cell_entries: int = CELL_ENTRIES, cell_visits: int = CELL_VISITS
) -> DataFrame:
    """``vectors`` with ``_best``, its ``k`` nearest entries (all, if fewer) with their distances, ties by id, and ``_compared``.

    ``vectors`` hold their components in ``_v``, ``index(entry_id, entry)`` its
    entries, all of doubles and one length. Entries that are null or have null or
    non-finite components take no part, and such vectors have no row; repeated
    rows are kept. ``_compared`` counts the distances computed for a vector,
    those to pivots included. Cells and their visitors are dealt out in parts of
    bounded size, so a crowded cell is no single task.
    """
    spark, kind = index.sparkSession, index.schema["entry_id"].dataType.simpleString()
    entries = materialized(index.where(_usable("entry") & (F.size("entry") > 0)).select("entry_id", "entry"), "entries")
    known = Pivots(entries, pivots)
    asked = vectors.where(_usable("_v"))
    none = asked.withColumn("_best", F.lit(None).cast(BEST.format(id=kind))).withColumn("_compared", F.lit(0).cast("long"))
    if not len(known.points):
        return none
    placed = materialized(entries.mapInPandas(known.assign(), f"entry_id {kind}, entry array<double>, cell int, off double"), "cells")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("radius")).toPandas()  # as many rows as pivots
    known.radius = np.full(len(known.points), -1.0)
    known.radius[sizes["cell"]] = sizes["radius"]
    parts = dict(zip(sizes["cell"].tolist(), (-(-sizes["n"] // cell_entries)).tolist()))
    points, radius = known.points, known.radius
    asked = materialized(asked.withColumn("_row", F.monotonically_increasing_id()), "asked")
    state = asked.select("_row", "_v", F.array().cast("array<double>").alias("_near"), F.lit(0).alias("_next"))
    kth = F.when(F.size("_near") >= k, F.try_element_at("_near", F.lit(-1)))
    found, step, visited = [], FIRST_VISITS, 0
    while True:
        visits = materialized(state.select("_row", "_v", "_next", kth.alias("_tau")).mapInPandas(
            _visits(points, radius, step), "_row bigint, _v array<double>, _tau double, _pivot double, cell int"
        ), "visits")
        # rows per cell: as many as pivots
        crowd = {r["cell"]: -(-r["n"] // cell_visits) for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not crowd:
            break
        own = F.broadcast(spark.createDataFrame([(c, parts[c], s) for c, s in crowd.items()], "_cell int, _parts int, _shares int"))
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = visits.join(own, F.col("cell") == F.col("_cell")).withColumn("_share", F.pmod(F.hash("_row"), F.col("_shares"))).withColumn(
            "_part", numbers("_parts")).drop("_cell", "_parts", "_shares")
        right = placed.join(own, F.col("cell") == F.col("_cell")).select(
            F.col("cell").alias("c"), F.pmod(F.xxhash64("entry_id", "off"), F.col("_parts")).cast("int").alias("p"), numbers("_shares").alias("s"),
            "entry_id", "entry", "off",
        )
        found.append(materialized(left.groupBy("cell", "_part", "_share").cogroup(right.groupBy("c", "p", "s")).applyInArrow(
            _compare(k), f"_row bigint, _best {BEST.format(id=kind)}, _compared bigint"
        ), "compared"))
        visited += step
        if visited >= len(points):
            break
        # who has visited none is done; the others go on with the distances they have
        near = found[-1].groupBy("_row").agg(F.flatten(F.collect_list(F.transform("_best", lambda b: b["d"]))).alias("_new"))
        state = materialized(state.join(near, "_row").select(
            "_row", "_v", F.slice(F.array_sort(F.concat("_near", "_new")), 1, k).alias("_near"), (F.col("_next") + step).alias("_next")
        ), "visitors")
        step *= 4
    if not found:
        return none
    merged = reduce(DataFrame.unionByName, found).groupBy("_row").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("_best"))), 1, k).alias("_best"), (F.sum("_compared") + len(points)).alias("_compared")
    )
    return asked.join(merged, "_row").drop("_row")


def _visits(points: np.ndarray, radius: np.ndarray, step: int):
    """The next ``step`` cells of each vector that may still hold one of its nearest."""
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at:at + 1024]
                vectors = _stacked(part["_v"].tolist())
                order, bound, far = _order_of_visits(vectors, points, radius)
                tau = part["_tau"].fillna(np.inf).to_numpy(dtype=np.float64)
                start = part["_next"].to_numpy()
                rows, cells = [], []
                for j in range(step):
                    place = start + j
                    inside = np.flatnonzero(place < len(points))
                    nearby = bound[inside, place[inside]]
                    open_ = inside[np.isfinite(nearby) & (nearby <= tau[inside] * (1 + SLACK) + SLACK)]
                    rows.append(open_)
                    cells.append(order[open_, place[open_]])
                rows, cells = np.concatenate(rows), np.concatenate(cells)
                yield pd.DataFrame({
                    "_row": part["_row"].to_numpy()[rows], "_v": part["_v"].to_numpy()[rows], "_tau": tau[rows],
                    "_pivot": far[rows, cells], "cell": cells.astype(np.int32),
                })

    return run


def _compare(k: int):
    """The ``k`` best of one part of a cell for each of its visitors."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, pivot, tau = left["_row"].to_pylist(), left["_pivot"].to_numpy(), left["_tau"].to_numpy()
        best, compared = [], []
        if len(right) and len(left):
            right = right.sort_by([("off", "ascending")])
            off, ids, points = right["off"].to_numpy(), right["entry_id"].to_pylist(), _stacked(right["entry"].to_pylist())
            reach = tau * (1 + SLACK) + SLACK
            low, high = np.searchsorted(off, pivot - reach, "left").tolist(), np.searchsorted(off, pivot + reach, "right").tolist()
            for v, a, b in zip(_stacked(left["_v"].to_pylist()), low, high):
                d = np.sqrt(((points[a:b] - v) ** 2).sum(axis=1))
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                top = sorted((float(d[i]), ids[a + i], a + int(i)) for i in near)[:k]
                best.append([{"d": x, "id": i, "entry": points[at].tolist()} for x, i, at in top])
                compared.append(b - a)
        else:
            rows = []
        entry_type = pa.list_(pa.struct([("d", pa.float64()), ("id", right["entry_id"].type), ("entry", pa.list_(pa.float64()))]))
        return pa.table({"_row": pa.array(rows, pa.int64()), "_best": pa.array(best, entry_type), "_compared": pa.array(compared, pa.int64())})

    return run
