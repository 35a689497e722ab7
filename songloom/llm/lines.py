"""Dropping lines that many documents share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from songloom.llm.runs import SortedRuns
from songloom.llm.shared import whole_text
from songloom.session import fresh_path, materialized

# Blanks of the ASCII range.
BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int = 1) -> bytes | None:
    """128-bit hash of a line without blanks at its ends and in lower case (A-Z only); None for shorter keys."""
    import xxhash

    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or min_chars > 1 and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(min_chars: int):
    def keys(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            ids, texts, found, batch = [], [], [], []
            for doc_id, text_hash, number, text in zip(*(c.to_pylist() for c in table.columns)):
                own = {line_key(line, min_chars) for line in text.encode().split(b"\n")} - {None}
                ids += [doc_id] * len(own)
                texts += [text_hash] * len(own)
                batch += [number] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch, pa.int32()), pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(found, pa.binary())],
                ["batch", "_id", "_hash", "key"],
            )

    return keys


def _without(texts: pd.Series, keys: pd.Series, min_chars: pd.Series) -> pd.DataFrame:
    out = []
    for text, drop, least in zip(texts, keys, min_chars):
        lines = text.encode().split(b"\n")
        if drop is None or not len(drop):
            out.append((len(lines), 0, text))
            continue
        gone = set(map(bytes, drop))
        left = [line for line in lines if line_key(line, least) not in gone]
        out.append((len(lines), len(lines) - len(left), b"\n".join(left).decode()))
    return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])


def drop_shared_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``docs`` with ``kept``, ``n_lines`` and ``n_dropped`` in one column ``lines`` (a struct).

    A line's key is the line without blanks at its ends, A-Z in lower case. Keys
    of ``min_chars`` or more characters that ``min_docs`` or more documents hold
    lose all their lines, everywhere. Rows of one id are one document, rows
    without an id are each their own. Null and empty texts have one empty line; a document may end with no
    line, then ``kept`` is empty. A column ``lines`` of the input is replaced.

    Lines are hashed once; the batches of hashes then pass through
    :class:`SortedRuns`. Texts move once, to meet the keys that they lose.
    """
    spark = docs.sparkSession
    key, text_hash = F.col(doc_id).cast("long"), F.xxhash64(whole_text(docs, text))
    # all rows of an id are in one batch
    number = F.pmod(F.when(key.isNull(), text_hash).otherwise(F.xxhash64(key)), F.lit(batches)).cast("int")
    own = docs.select(key.alias("_id"), text_hash.alias("_hash"), number.alias("_batch"), whole_text(docs, text).alias("_text"))
    again = own.where("_id IS NOT NULL").groupBy("_id").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    again = materialized(again.select(F.col("_id").alias("_again")), "repeated-ids")
    path = fresh_path(spark, "line-keys")
    hashed = own.mapInArrow(_keys(min_chars), "batch int, _id long, _hash long, key binary")
    hashed.write.partitionBy("batch").parquet(path)
    keyed = spark.read.schema("_id long, _hash long, key binary, batch int").parquet(path)
    runs = SortedRuns(spark, min_docs, fanout)
    try:
        for batch in range(batches):
            rows, repeated = keyed.where(F.col("batch") == batch), F.col("_id") == F.col("_again")
            once = rows.join(again, repeated, "left_anti").select("key")
            runs.add(once.union(rows.join(again, repeated, "left_semi").select("_id", "key").distinct().select("key")))
        frequent = materialized(runs.frequent(), "frequent-lines")
    finally:
        runs.close()
    lost = (
        keyed.join(frequent.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"))
        .groupBy("_id", "_hash").agg(F.collect_set("key").alias("_lost"))
        .select(F.col("_id").alias("_lost_id"), F.col("_hash").alias("_lost_hash"), "_lost")
    )
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_lost_id")) & (F.xxhash64(whole_text(docs, text)) == F.col("_lost_hash"))
    without = F.pandas_udf(_without, "n_lines long, n_dropped long, kept string")
    joined = docs.drop("lines").join(lost, same, "left")
    return joined.withColumn("lines", without(whole_text(docs, text), F.col("_lost"), F.lit(min_chars))).drop(
        "_lost_id", "_lost_hash", "_lost"
    )
