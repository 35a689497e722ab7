"""Levelled sorted runs of counted keys, kept as bucketed tables of the warehouse."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from songloom.llm.shared import shuffle_parts


class SortedRuns:
    """How many documents hold each key, over batches that arrive one after the other.

    A run is a table ``(key, n)``, bucketed and sorted by key, so merging runs and
    anti-joining a batch against them are merge joins that move no run. ``fanout``
    runs of a level are compacted into one of the next, so a key is rewritten as
    often as there are levels, a logarithm of the number of batches.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2):
        if fanout < 2 or min_docs < 1:
            raise ValueError("fanout must be two or more, min_docs one or more")
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = shuffle_parts(spark)
        self.levels: list[list[str]] = []

    def _store(self, counted: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        counted.select("key", "n").write.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def _merged(self, names: list[str]) -> DataFrame:
        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select(F.col("key").alias("_k"), F.col("n").alias("_n"))
            both = F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))
            return a.join(b, F.col("key") == F.col("_k"), "full").select(F.coalesce("key", "_k").alias("key"), both.alias("n"))

        return reduce(two, [self.spark.table(n) for n in names])

    def add(self, keys: DataFrame) -> None:
        """Add a batch with one row per document and key.

        Keys that some run already holds often enough are settled: the batch is
        anti-joined against those, and only what is left becomes its own run.
        """
        fresh = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        for name in [n for level in self.levels for n in level]:
            settled = self.spark.table(name).where(F.col("n") >= self.min_docs).select("key")
            fresh = fresh.join(settled, "key", "left_anti")
        self._push(self._store(fresh), 0)

    def _push(self, name: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            old = self.levels[level]
            compacted = self._store(self._merged(old))
            self._drop(old)
            self.levels[level] = []
            self._push(compacted, level + 1)

    def frequent(self) -> DataFrame:
        """Keys of ``min_docs`` or more documents over all runs."""
        names = [n for level in self.levels for n in level]
        return self._merged(names).where(F.col("n") >= self.min_docs).select("key")

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []
