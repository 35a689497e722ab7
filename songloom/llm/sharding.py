"""Balanced shards by longest-processing-time scheduling.

Scheduling only needs to know how many groups there are of each size, so it
reads a histogram: one row per distinct size, at most the square root of twice
all bytes (D different sizes sum to at least D*(D+1)/2). The rows stream through
one task in order of size; nothing is collected. Groups of one size are told
apart by their place in a range-partitioned order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from songloom.llm.shared import crc, whole_text
from songloom.session import materialized


class Schedule:
    """Deals items, largest first, each to the least loaded shard; ties go to the smaller shard."""

    def __init__(self, shards: int):
        self.heap = [(0, k) for k in range(shards)]

    def deal(self, size: int, count: int) -> list[tuple[int, int]]:
        """``(shard, number)`` for ``count`` items of one size.

        The heap would hand them out one by one. All that it hands out before
        loads meet within one size is counted at once: shard k gets its j-th
        item when the level reaches load + j * size, so a level is sought under
        which at most ``count`` items lie; the rest goes through the heap.
        """
        given = dict.fromkeys((k for _, k in self.heap), 0)
        loads = {k: load for load, k in self.heap}
        if count > len(loads):
            low, high = 0, max(loads.values()) + size * (count // len(loads) + 1)
            under = lambda level: sum(max(0, (level - load) // size) for load in loads.values())
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if under(mid) <= count else (low, mid - 1)
            for k in loads:
                given[k] = max(0, (low - loads[k]) // size)
                loads[k] += given[k] * size
            count -= sum(given.values())
        heap = [(load, k) for k, load in loads.items()]
        heapq.heapify(heap)
        for _ in range(count):
            load, k = heap[0]
            given[k] += 1
            heapq.heapreplace(heap, (load + size, k))
        self.heap = heap
        return [(k, n) for k, n in given.items() if n]


def _scheduled(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule, before = Schedule(shards), 0
        for batch in batches:
            rows = []
            for size, count in zip(*(c.to_pylist() for c in batch.columns)):
                first = before
                for shard, n in schedule.deal(size, count):
                    rows.append((size, shard, first, first + n))
                    first += n
                before += count
            sizes, shard, first, end = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(shard, pa.int32()), pa.array(first, pa.int64()), pa.array(end, pa.int64())],
                ["_size", "shard", "_first", "_end"],
            )

    return run


def in_slices(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with ``_slice`` and the place in it, ``_pos``.

    Written to the shared folder, so every later pass sees the same places.
    """
    placed = F.monotonically_increasing_id()
    sliced = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialized(
        sliced.withColumn("_slice", F.spark_partition_id()).withColumn("_pos", placed.bitwiseAND(F.lit((1 << 33) - 1))), name
    )


def _offsets(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in earlier slices, from ``(*keys, _slice, _n)``; the table is as small as the number of slices."""
    before = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def lpt_shards(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``: shards of nearly equal bytes that keep equal texts together.

    The size of a row is the UTF-8 bytes of its text plus one; null counts as the
    empty text. Groups are equal texts, repeated rows included; a group's size is
    the sum of its rows. Groups of equal size are taken in order of their least
    id (nulls first), then of the hash of their text. Slots run from 0 in each
    shard, in order of id; of rows with equal ids in any order. Groups are told
    apart by SHA-256 of the text. Text is read once and never moved.
    """
    whole = whole_text(docs, text).cast("binary")
    base = materialized(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(whole, 256)).alias("_key"),
        (F.octet_length(whole) + 1).cast("long").alias("size"), crc(whole_text(docs, text)).alias("text_crc32"),
    ), "sizes")
    groups = base.groupBy("_key").agg(F.sum("size").alias("_size"), F.min("doc_id").alias("_least"))
    ordered = in_slices(groups, [F.desc("_size"), F.asc("_least"), F.asc("_key")], "groups")
    # one row per distinct size, streamed in order through one task
    histogram = ordered.groupBy("_size").agg(F.count(F.lit(1)).alias("_n")).repartition(1).sortWithinPartitions(F.desc("_size"))
    plan = histogram.mapInArrow(_scheduled(shards), "_size long, shard int, _first long, _end long")
    plan = plan.groupBy("_size").agg(F.sort_array(F.collect_list(F.struct("_end", "shard"))).alias("_plan"))
    offsets = _offsets(ordered.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n")), []).select(
        F.col("_slice").alias("_s"), "_before"
    )
    # one row per slice: bounded by the number of partitions
    placed = ordered.join(F.broadcast(offsets), F.col("_slice") == F.col("_s")).select(
        "_key", "_size", (F.col("_before") + F.col("_pos")).alias("_at")
    )
    chosen = placed.join(plan.withColumnRenamed("_size", "_z"), F.col("_size") == F.col("_z")).select(
        F.col("_key").alias("_k"),
        F.filter("_plan", lambda p: p["_end"] > F.col("_at"))[0]["shard"].alias("shard"),
    )
    rows = base.join(chosen, F.col("_key") == F.col("_k")).select("doc_id", "size", "text_crc32", "shard")
    sliced = in_slices(rows, ["shard", "doc_id"], "sharded")
    runs = sliced.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_start"))
    # at most one row per slice and shard: bounded by partitions plus shards
    before = _offsets(runs, ["shard"]).select(
        F.col("shard").alias("_sh"), F.col("_slice").alias("_s"), (F.col("_before") - F.col("_start")).alias("_shift")
    )
    return sliced.join(F.broadcast(before), (F.col("shard") == F.col("_sh")) & (F.col("_slice") == F.col("_s"))).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_pos") + F.col("_shift")).alias("slot")
    )
