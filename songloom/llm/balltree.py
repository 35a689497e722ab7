"""Exact top-k inner products by branch and bound over ball trees.

Vectors are dealt into shards of near ones, cells around a bounded number of
pivots; each shard's tree is built once and stored. Queries travel in blocks, dealt the same way. A
block is first searched in a shard of its own cell. Then it meets the root balls of all shards,
some hundred to a row: only the shards whose upper bound reaches the k-th scores
found are joined with it, and leave out from the start every ball below them.
A ball with center c and radius r holds no score above q.c + |q|r.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from songloom.session import materialized

LEAF = 64
# Most pivots of the shards: they travel to the driver and to every task.
PIVOTS = 1024
# Root balls that a block meets in one row.
ROOTS = 256
NONE = -np.inf


def integer_vectors(df: DataFrame, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, dim, v)`` with v = floor(scale * x); vectors that are null or hold a null, NaN or infinity are left out.

    Repeated rows count once.
    """
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).where(usable)
        .select(
            F.col(vec_id).cast("long").alias("vec_id"), F.size(vector).alias("dim"),
            F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
        ).distinct()
    )


def _matrix(rows: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.array(rows.to_pylist(), dtype=np.int64).reshape(len(rows), dim)


def _pack(values: np.ndarray) -> tuple[str, bytes]:
    """The narrowest integers that hold the values."""
    for kind in ("<i1", "<i2", "<i4"):
        if not values.size or np.iinfo(kind).min <= values.min() and values.max() <= np.iinfo(kind).max:
            return kind, values.astype(kind).tobytes()
    return "<i8", values.astype("<i8").tobytes()


class Tree:
    """A ball tree over integer rows; nodes are numbered from the root, children behind their parent."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.dim = rows.shape[1]
        order, nodes = np.arange(len(ids)), []
        points = rows.astype(np.float64)
        open_nodes = [(0, len(ids), -1)]
        while open_nodes:
            start, end, parent = open_nodes.pop()
            own = order[start:end]
            center = points[own].mean(axis=0)
            apart = np.sqrt(((points[own] - center) ** 2).sum(axis=1))
            number = len(nodes)
            nodes.append([start, end, -1, -1, center, apart.max(), ids[own].min()])
            if parent >= 0:
                nodes[parent][2 if nodes[parent][2] < 0 else 3] = number
            if end - start > leaf:
                far = points[own[apart.argmax()]]
                other = points[own[((points[own] - far) ** 2).sum(axis=1).argmax()]]
                middle = (end - start) // 2  # halves by rank, so equal vectors split as well
                order[start:end] = own[np.argpartition(points[own] @ (other - far), middle)]
                open_nodes += [(start, start + middle, number), (start + middle, end, number)]
        self.ids, self.rows = ids[order], rows[order]
        self.place = np.array([n[:4] for n in nodes], dtype=np.int64)
        self.centers = np.array([n[4] for n in nodes])
        self.radii = np.array([n[5] for n in nodes])
        self.least = np.array([n[6] for n in nodes], dtype=np.int64)

    def packed(self) -> dict:
        kind, rows = _pack(self.rows)
        return {
            "ids": self.ids.astype("<i8").tobytes(), "kind": kind, "rows": rows, "place": self.place.tobytes(),
            "centers": self.centers.tobytes(), "radii": self.radii.tobytes(), "least": self.least.tobytes(),
        }

    @classmethod
    def unpacked(cls, row: dict, dim: int) -> Tree:
        tree = cls.__new__(cls)
        tree.dim, tree.ids = dim, np.frombuffer(row["ids"], "<i8")
        tree.rows = np.frombuffer(row["rows"], row["kind"]).reshape(len(tree.ids), dim)
        tree.place = np.frombuffer(row["place"], np.int64).reshape(-1, 4)
        tree.centers = np.frombuffer(row["centers"]).reshape(len(tree.place), dim)
        tree.radii, tree.least = np.frombuffer(row["radii"]), np.frombuffer(row["least"], np.int64)
        return tree

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of each query's k best rows (score -inf: none), never its own id.

        ``known`` holds a score per query that k other rows reach already (-inf:
        unknown); rows below it may be missing. Equal scores: smaller id first.
        """
        best = np.full((len(queries), k), NONE)
        best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        points = queries.astype(np.float64)
        norms = np.sqrt((points**2).sum(axis=1))
        size = np.abs(self.centers).max(initial=0) + self.radii.max(initial=0)
        slack = 1e-9 * (norms * size * max(1, self.dim) + 1)

        def open_queries(node: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            bound = np.floor(points[asked] @ self.centers[node] + norms[asked] * self.radii[node] + slack[asked])
            kth = best[asked, -1]
            lasting = (bound >= known[asked]) & ((bound > kth) | (bound == kth) & (self.least[node] < best_ids[asked, -1]))
            return asked[lasting], bound[lasting]

        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, asked = stack.pop()
            asked, _ = open_queries(node, asked)
            if not len(asked):
                continue
            start, end, left, right = self.place[node]
            if left < 0:
                scores = points[asked] @ self.rows[start:end].astype(np.float64).T
                ids = np.broadcast_to(self.ids[start:end], scores.shape)
                scores[ids == query_ids[asked, None]] = NONE
                scores, ids = np.hstack([best[asked], scores]), np.hstack([best_ids[asked], ids])
                first = np.lexsort((ids, -scores), axis=-1)[:, :k]
                best[asked] = np.take_along_axis(scores, first, axis=1)
                best_ids[asked] = np.take_along_axis(ids, first, axis=1)
                continue
            sides = [(side, *open_queries(side, asked)) for side in (left, right)]
            # the side of the greater bounds is searched first, so it comes last on the stack
            sides.sort(key=lambda s: s[2].mean() if len(s[2]) else NONE)
            stack += [(side, own) for side, own, _ in sides if len(own)]
        return best_ids, best


def _nearest(known: dict[int, np.ndarray]):
    """The cell of each vector: its nearest pivot of the same dimension, 0 where there is none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                cell, dims = np.zeros(part.num_rows, dtype=np.int64), part.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    if dim in known:
                        rows, pivots = np.flatnonzero(dims == dim), known[dim]
                        points = _matrix(part.column("v").take(pa.array(rows)), dim).astype(np.float64)
                        # the squared norm of the point is the same for all pivots
                        cell[rows] = ((pivots**2).sum(axis=1)[None, :] - 2 * points @ pivots.T).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell)], [*part.schema.names, "cell"])

    return run


class Cells:
    """Cells around pivots, which are chosen by the hash of their id among all vectors."""

    def __init__(self, vectors: DataFrame, most: int):
        chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "dim").limit(max(0, most)).toArrow() if most > 1 else None
        self.pivots: dict[int, np.ndarray] = {}
        for dim in set(chosen["dim"].to_pylist()) - {0} if chosen is not None else ():
            own = chosen.filter(pc.equal(chosen["dim"], dim))
            self.pivots[dim] = np.unique(_matrix(own["v"], dim), axis=0).astype(np.float64)

    def dealt(self, rows: DataFrame, size: int, out: str) -> DataFrame:
        """``(vec_id, dim, v)`` with a number in ``out``: the cell, and below it parts of about ``size`` rows."""
        plain = rows.select("vec_id", "dim", "v")
        placed = materialized(plain.mapInArrow(_nearest(self.pivots), "vec_id long, dim int, v array<long>, cell long"), "cells")
        # a row per cell and dimension
        counts = placed.groupBy(F.col("dim").alias("_dim"), F.col("cell").alias("_cell")).agg(F.ceil(F.count(F.lit(1)) / size).alias("_parts"))
        own = placed.join(materialized(counts, "cell-sizes"), (F.col("dim") == F.col("_dim")) & (F.col("cell") == F.col("_cell")))
        number = F.shiftleft("cell", 32) + F.pmod(F.xxhash64("vec_id"), F.col("_parts"))
        return own.select("vec_id", "dim", "v", number.alias(out))


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shards of a row whose root ball may hold one of the best of some query in the block."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            dim, shards = row["dim"], row["shards"]
            queries = np.frombuffer(row["queries"], "<i8").reshape(len(row["query_ids"]) // 8, dim).astype(np.float64)
            known = np.full(len(queries), NONE) if row["known"] is None else np.frombuffer(row["known"])
            centers, radii = np.frombuffer(b"".join(row["centers"])).reshape(len(shards), dim), np.frombuffer(b"".join(row["radii"]))
            norms = np.sqrt((queries**2).sum(axis=1))
            slack = 1e-9 * (norms * (np.abs(centers).max(initial=0) + radii.max(initial=0)) * max(1, dim) + 1)
            bound = np.floor(queries @ centers.T + norms[:, None] * radii[None, :] + slack[:, None])
            rows += [(dim, row["block"], shards[j]) for j in np.flatnonzero((bound >= known[:, None]).any(axis=0)).tolist()]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["dim", "block", "shard"])


TREE = "dim int, shard long, ids binary, kind string, rows binary, place binary, centers binary, radii binary, least binary"
BLOCK = "dim int, block long, query_ids binary, queries binary"


def _build(table: pa.Table) -> pa.Table:
    dim = table["dim"][0].as_py()
    tree = Tree(table["vec_id"].to_numpy(), _matrix(table["v"], dim))
    row = {"dim": dim, "shard": table["shard"][0].as_py(), **tree.packed()}
    kinds = {"dim": pa.int32(), "shard": pa.int64(), "kind": pa.string()}
    return pa.table({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})


def _block(table: pa.Table) -> pa.Table:
    dim = table["dim"][0].as_py()
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "block": pa.array([table["block"][0].as_py()], pa.int64()),
        "query_ids": pa.array([table["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
        "queries": pa.array([_matrix(table["v"], dim).astype("<i8").tobytes()], pa.binary()),
    })


def _searched(k: int, only_kth: bool):
    def run(table: pa.Table) -> pa.Table:
        row = {c: table[c][0].as_py() for c in table.column_names}
        dim, query_ids = row["dim"], np.frombuffer(row["query_ids"], "<i8")
        known = np.full(len(query_ids), NONE)
        if row.get("known") is not None:
            known = np.frombuffer(row["known"])
        tree = Tree.unpacked(row, dim)
        ids, scores = tree.search(query_ids, np.frombuffer(row["queries"], "<i8").reshape(len(query_ids), dim), k, known)
        if only_kth:
            return pa.table({
                "dim": pa.array([dim], pa.int32()), "block": pa.array([row["block"]], pa.int64()),
                "known": pa.array([scores[:, -1].tobytes()], pa.binary()),
            })
        at, rank = np.nonzero(scores > NONE)
        return pa.table({
            "query_id": query_ids[at], "vec_id": ids[at, rank], "score": scores[at, rank].astype(np.int64),
        })

    return run


def nearest_by_inner_product(
    vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 4096, block_rows: int = 512
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the k rows of the greatest inner product.

    Both inputs are as :func:`integer_vectors` gives them. Ranks start at 1; equal
    scores go by smaller vec_id; a query never finds rows of its own vec_id; only
    vectors of equal length meet. Fewer rows come back where there are fewer
    candidates. Scores must stay below 2**53, else an error is raised.
    """
    limits = vectors.select(F.count(F.lit(1)), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))), F.max("dim")).first()
    if limits[1] and limits[1] ** 2 * max(1, limits[2]) >= 2**53:
        raise ValueError("components are too large for exact scores")
    cells = Cells(vectors, min(PIVOTS, -(-limits[0] // shard_rows)))
    index = materialized(
        cells.dealt(vectors, shard_rows, "shard").groupBy("dim", "shard").applyInArrow(_build, TREE), "ball-trees"
    )
    asked = materialized(
        cells.dealt(queries, block_rows, "block").groupBy("dim", "block").applyInArrow(_block, BLOCK), "query-blocks"
    )
    # numbers of shards and blocks begin with the cell; every dimension has a least shard in some cell
    cell = lambda c: F.shiftright(c, 32)
    own = index.groupBy("dim", cell(F.col("shard")).alias("_cell")).agg(F.min("shard").alias("_own"))
    any_ = index.groupBy(F.col("dim").alias("_dim")).agg(F.min("shard").alias("_any"))
    start = (
        asked.withColumn("_cell", cell(F.col("block"))).join(own, ["dim", "_cell"], "left").join(any_, F.col("dim") == F.col("_dim"), "left")
        .withColumn("shard", F.coalesce("_own", "_any")).drop("_cell", "_own", "_dim", "_any")
    )
    first = start.join(index, ["dim", "shard"]).groupBy("dim", "shard", "block").applyInArrow(
        _searched(k, True), "dim int, block long, known binary"
    )
    known = materialized(asked.join(first, ["dim", "block"], "left"), "known-blocks")
    size = F.col("dim") * 8
    roots = index.select("dim", "shard", F.substring("centers", F.lit(1), size).alias("center"), F.substring("radii", 1, 8).alias("radius"))
    packed = materialized(roots.groupBy("dim", F.pmod(F.xxhash64("shard"), F.lit(-(-limits[0] // (shard_rows * ROOTS)) or 1)).alias("pack")).agg(
        F.collect_list("shard").alias("shards"), F.collect_list("center").alias("centers"), F.collect_list("radius").alias("radii")
    ), "root-balls")
    reached = known.join(packed, "dim").select("dim", "block", "query_ids", "queries", "known", "shards", "centers", "radii").mapInArrow(
        _reached, "dim int, block long, shard long"
    )
    reached = materialized(reached, "reached-shards")
    met = known.join(reached, ["dim", "block"]).join(index, ["dim", "shard"])
    found = met.groupBy("dim", "shard", "block").applyInArrow(_searched(k, False), "query_id long, vec_id long, score long")
    ranked = found.withColumn(
        "rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    )
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
