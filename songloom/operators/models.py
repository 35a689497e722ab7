"""Choosing model assets and applying user-supplied models to tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

# Asset suffixes.
ONNX = ".onnx"
WEIGHTS = ".pth"


def model_route(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """Resolve the path and family of each requested model.

    ``requests(request_id, base_dir, model)`` and ``assets(dir, name)``. A name
    with the onnx suffix is family A as it stands; a missing name whose onnx
    sibling exists becomes that sibling; everything else is family B.
    """
    stem = F.regexp_replace("name", r"\.onnx$", "")
    # one row per (dir, stem): does the plain name exist, does its onnx sibling
    listing = (
        assets.select(F.col("dir").alias("base_dir"), F.explode(F.array(
            F.struct(F.col("name").alias("model"), F.lit(True).alias("plain"), F.lit(False).alias("onnx")),
            F.struct(stem.alias("model"), F.lit(False).alias("plain"), F.col("name").endswith(ONNX).alias("onnx")),
        )).alias("e"))
        .select("base_dir", "e.*")
        .groupBy("base_dir", "model").agg(F.bool_or("plain").alias("_plain"), F.bool_or("onnx").alias("_onnx"))
    )
    path = F.concat_ws("/", "base_dir", "model")
    sibling = ~F.coalesce("_plain", F.lit(False)) & F.coalesce("_onnx", F.lit(False))
    direct = F.col("model").endswith(ONNX)
    return requests.join(listing, ["base_dir", "model"], "left").select(
        "request_id",
        F.when(~direct & sibling, F.concat(path, F.lit(ONNX))).otherwise(path).alias("path"),
        F.when(direct | sibling, "A").otherwise("B").alias("family"),
    )


def batch_apply_model(
    rows: DataFrame,
    load: Callable[[object], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: StructType | str,
    model_col: str = "model_id",
    spread_by: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Apply ``load(model_id)(batch)`` to rows, loading once per run of equal ids.

    Rows are range-partitioned by model and ``spread_by`` and sorted, so a
    partition holds few models and a hot model spans several partitions
    instead of filling one. Rows without a model go to ``load(None)``.
    """
    order = [model_col] + ([spread_by] if spread_by else [])
    laid_out = (
        rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    ).sortWithinPartitions(model_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_id, held = None, None
        for batch in batches:
            for model_id, part in batch.groupby(model_col, sort=False, dropna=False):
                model_id = None if pd.isna(model_id) else model_id
                if held is None or model_id != held_id:
                    held_id, held = model_id, load(model_id)
                yield held(part)

    return laid_out.mapInPandas(run, schema)
