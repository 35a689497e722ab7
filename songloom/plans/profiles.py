"""Voice profiles of a folder of sample files, kept from run to run."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from songloom.operators.pitch import MIN_VOICED_FRAMES, voiced_median
from songloom.session import materialized

# Files whose contents are read in one job.
FILES_AT_ONCE = 10_000
_HISTORY = "path string, mtime bigint, median_hz double, run bigint"


def _history(spark: SparkSession, store: str) -> DataFrame:
    """What the last run that looked at a file found, per path."""
    try:
        runs = spark.read.schema(_HISTORY).parquet(store)
    except AnalysisException:  # first run
        runs = spark.createDataFrame([], _HISTORY)
    latest = F.max_by(F.struct("mtime", "median_hz", "run"), "run").alias("h")
    return runs.groupBy("path").agg(latest).select("path", "h.*")


def profile_folder(
    spark: SparkSession, folder: str, store: str, frames_of: Callable[[DataFrame], DataFrame], pattern: str = "*.wav",
    min_voiced: int = MIN_VOICED_FRAMES, files_at_once: int = FILES_AT_ONCE,
) -> DataFrame:
    """``(path, mtime, median_hz, recomputed)`` for every file of ``folder``.

    Files are listed without their contents. One whose path and time of change
    are in the ``store`` as of its last run keeps its profile; any other time of
    change, also an older one, makes it a miss. Only misses are read, some at a
    time, and given to ``frames_of(files(path, content))``, which returns
    ``(path, frame_no, hz)``. Their medians (null with fewer than ``min_voiced`` voiced
    frames) are added to the store as a run of their own; a run that fails
    adds nothing and may be repeated.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    listed = files.load(folder).select("path", F.unix_micros("modificationTime").alias("mtime"))
    history = materialized(_history(spark, store), "profile-history")
    known = history.select(F.col("path").alias("_path"), F.col("mtime").alias("_mtime"), "median_hz")
    looked = materialized(
        listed.join(known, (F.col("path") == F.col("_path")) & (F.col("mtime") == F.col("_mtime")), "left")
        .select("path", "mtime", "median_hz", F.col("_path").isNull().alias("recomputed")), "profiles"
    )
    last = history.agg(F.max("run")).first()[0]
    misses, found = looked.where("recomputed"), []
    paths = (row[0] for row in misses.select("path").toLocalIterator())
    while some := list(islice(paths, files_at_once)):
        frames = frames_of(spark.read.format("binaryFile").load(some).select("path", "content")).withColumnRenamed("path", "signal_id")
        medians = voiced_median(frames, min_voiced=min_voiced).select(F.col("signal_id").alias("_path"), F.nullif("median_hz", F.lit(0.0)).alias("median_hz"))
        found.append(materialized(medians, "profile-medians"))
    hits = looked.where("NOT recomputed")
    if not found:
        return hits
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    fresh = misses.drop("median_hz").join(every, F.col("path") == F.col("_path"), "left").select("path", "mtime", "median_hz", "recomputed")
    fresh = materialized(fresh, "profiles-new")
    fresh.drop("recomputed").withColumn("run", F.lit(0 if last is None else last + 1).cast("bigint")).write.mode("append").parquet(store)
    return hits.unionByName(fresh)
