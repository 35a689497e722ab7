"""Model asset listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Default suffixes of model weights and of audio.
WEIGHTS = ".pth"
WAV = ".wav"


def assets_from_folder(spark: SparkSession, path: str) -> DataFrame:
    """``dir, name`` of every file under a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.select(
        F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name")
    )


def asset_listing(assets: DataFrame, suffix: str = WEIGHTS) -> DataFrame:
    """Names with a suffix, in ascending order."""
    return assets.where(F.col("name").endswith(suffix)).select("dir", "name").orderBy("name", "dir")


def first_asset_per_dir(dirs: DataFrame, assets: DataFrame, suffix: str = WAV) -> DataFrame:
    """Smallest name with the suffix per directory, '' where there is none."""
    first = assets.where(F.col("name").endswith(suffix)).groupBy("dir").agg(F.min("name").alias("_first"))
    return dirs.select("dir").distinct().join(first, "dir", "left").select(
        "dir", F.coalesce("_first", F.lit("")).alias("first_name")
    )
