"""Run a streaming DataFrame over everything available."""

from __future__ import annotations

from pyspark.sql import DataFrame

from songloom.session import scratch_path

def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive ``stream`` through a Parquet sink in the shared folder and read it back."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_batches(stream: DataFrame, name: str, each) -> None:
    """Drive ``stream`` through ``each(batch, batch_id)`` until nothing is left."""
    base = scratch_path(stream.sparkSession, name)
    query = (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
