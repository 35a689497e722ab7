"""Ordering and rank statistics that never gather one key in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from songloom.session import checkpointed, materialized


def range_slices(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """Rows in contiguous, sorted slices of ``order``, numbered in ``_slice``.

    Range partitioning cuts by share of rows, so a hot key covers as many
    slices as it fills, and only the first key of a slice can have rows in the
    slice before. ``order`` should be unique per row. The result is
    checkpointed: every later pass, also one repeated after the loss of an
    executor, sees the same slices.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return checkpointed(ranged.sortWithinPartitions(*order).withColumn("_slice", F.spark_partition_id()))


def numbered_within(
    df: DataFrame, keys: list[str], order: list[str], out: str, start: int = 0, partitions: int | None = None
) -> DataFrame:
    """Row number per key in ``order``, without gathering a key in one task.

    Rows are numbered inside their slice and shifted by the key's rows in
    earlier slices; at most one key per slice needs the shift.
    """
    sliced = range_slices(df, keys + order, partitions)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("_before", F.sum("_n").over(earlier)).where(F.col("_before") > 0)
        .select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_slice").alias("_o_slice"), "_before")
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = sliced.withColumn("_rn", F.row_number().over(inside))
    same = reduce(
        lambda a, b: a & b,
        [F.col("_slice") == F.col("_o_slice")] + [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys],
    )
    # at most one row per slice, so the hint is bounded by the partition count
    return (
        numbered.join(F.broadcast(offsets), same, "left")
        .withColumn(out, (F.col("_rn") - 1 + start + F.coalesce("_before", F.lit(0))).cast("bigint"))
        .select(*df.columns, out)
    )


def exact_median(df: DataFrame, key: str, value: str, bins_per_unit: float = 16.0, out: str = "median") -> DataFrame:
    """Exact median of ``value`` per key, with the count, in two counting passes.

    Pass 1 counts rows per (key, bin): a partial aggregation whose shuffle is
    bounded by the number of bins. Pass 2 looks only at rows of the bins that
    hold the middle ranks, again counted by distinct value before the shuffle.
    No key is ever sorted or collected as a whole.
    """
    binned = df.where(F.col(value).isNotNull()).select(
        key, F.col(value).cast("double").alias("_v"),
        F.floor(F.col(value).cast("double") * bins_per_unit).alias("_bin"),
    )
    hist = binned.groupBy(key, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    by_key = W.partitionBy(key)
    upto = by_key.orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = hist.select(
        key, "_bin", "_n",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.sum("_n").over(by_key).alias("_total"),
    )
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    middle = marked.where((F.col("_before") < high) & (F.col("_before") + F.col("_n") >= low)).select(
        F.col(key).alias("_k"), F.col("_bin").alias("_b"), "_before", "_total"
    )
    values = (
        binned.join(materialized(middle, "middle-bins"), (F.col(key) == F.col("_k")) & (F.col("_bin") == F.col("_b")))
        .groupBy(key, "_bin", "_v", "_before", "_total")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    inside = W.partitionBy(key, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = values.withColumn("_hi", F.col("_before") + F.sum("_c").over(inside)).withColumn(
        "_lo", F.col("_hi") - F.col("_c")
    )
    at = lambda rank: F.max(F.when((F.col("_lo") < rank) & (F.col("_hi") >= rank), F.col("_v")))
    return ranked.groupBy(key).agg(
        F.max("_total").alias("n_values"), ((at(low) + at(high)) / 2).alias(out)
    )
