"""A corpus pipeline over the documents table: five stages, each over all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run`
writes it as Parquet to the shared folder and the next stage reads that. All but
the last return the columns of ``documents``. No stage can be written in SQL as
a whole, so the tests hold the pipeline against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from songloom.llm.bpe import bpe_encode, token_count
from songloom.llm.decontamination import with_leaks
from songloom.llm.langid import fit_languages, identified
from songloom.llm.lines import drop_shared_lines
from songloom.llm.registered import tokenizer
from songloom.llm.shared import sha, small_batches
from songloom.llm.simhash import one_of_each
from songloom.session import materialized

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; texts without letters and ambiguous ones go.

    The model learns from all documents with a language; a missing language is filled in.
    """
    small_batches(spark)
    found = identified(docs, fit_languages(docs))
    kept = found.where((F.col("lang_pred") != "und") & ~F.col("ambiguous"))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; a document may end up empty."""
    small_batches(spark)
    done = drop_shared_lines(docs)
    return done.withColumn("text", F.col("lines.kept")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id."""
    small_batches(spark)
    return one_of_each(docs).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return with_leaks(docs, items, out="_leaks").where(F.size("_leaks") == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    small_batches(spark)
    path, pattern = tokenizer()
    coded = bpe_encode(docs.select("doc_id", "text"), path, pattern, decoded="_decoded")
    same = F.col("_decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", token_count(F.col("ids")).alias("n_tokens"), sha(F.col("ids")).alias("ids_sha256"), "ids", same.alias("decodes"))


STAGES = [
    ("language", language), ("shared_lines", shared_lines), ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks), ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written once and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
