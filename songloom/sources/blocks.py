"""Block tables at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PLACE = ("signal_id", "ch", "block_no")


def save_blocks(blocks: DataFrame, table: str, buckets: int) -> None:
    """Store a block table bucketed and sorted by the place of its blocks.

    Operators that pair two tracks join on that place; two tables with the same
    number of buckets are then joined without moving a sample.
    """
    blocks.write.mode("overwrite").bucketBy(buckets, *PLACE).sortBy(*PLACE).saveAsTable(table)


def load_blocks(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
