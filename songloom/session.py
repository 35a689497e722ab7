"""Session helpers shared by the jobs in this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app: str = "songloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew joins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # one row per signal of a large collection still fits
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # call sites of column expressions are not recorded: plans build twice as fast
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# folders that go when their results are no longer needed
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets a scratch folder, set as
    its checkpoint folder; a cluster without a shared folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(scratch)
    return spark.sparkContext.getCheckpointDir() or scratch


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/songloom/{name}-{uuid.uuid4().hex}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """As :func:`fresh_path`, and removed with what :func:`materialized` writes."""
    _WRITTEN.append(fresh_path(spark, name))
    return _WRITTEN[-1]


def checkpointed(df):
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def materialized(df, name: str):
    """Write ``df`` once as a Parquet table in the shared folder and read that.

    For results of costly user functions that several later steps read: they
    run once, and a lost executor re-reads files instead of running them again.
    Also for summaries that are joined back to what they sum up: the planner
    then knows their true size, and the large side is not read for them twice.
    :func:`clear_written` removes the folders when their results are no longer needed.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder of any file system that Spark reaches; whether there was one."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def written(spark: SparkSession) -> Iterator[None]:
    """Remove at its end what was written within, and nothing that another caller of the process still reads."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in [p for p in _WRITTEN if p not in before]:
            _WRITTEN.remove(path)
            delete_path(spark, path)


def clear_written(spark: SparkSession) -> int:
    """Remove the folders that :func:`materialized` wrote in this process; DataFrames that read them end with it."""
    removed = 0
    while _WRITTEN:
        removed += delete_path(spark, _WRITTEN.pop())
    return removed
