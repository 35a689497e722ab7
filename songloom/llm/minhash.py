"""Near copies by exact Jaccard similarity of word shingles, candidates from banded MinHash.

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Candidates share one of 24 bands of five minima: a
pair of similarity s meets with probability 1 - (1 - s^5)^24, 0.9999 at 0.8.
Every candidate's similarity is computed from the texts before it counts. Only
components matter, so of a bucket first the least member meets all others, and
pairs are compared in full where a bucket still spans several components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from songloom.llm.arrays import U, mixed, together, window_hashes, words_of
from songloom.llm.components import components
from songloom.llm.shared import whole_text
from songloom.session import materialized

SHINGLE = 5
# Least similarity of near copies, as a fraction so that it is compared without rounding.
LEAST = (4, 5)
BANDS, ROWS = 24, 5
# Texts of a bucket that a task compares at once; a larger bucket is dealt out as pairs of parts.
BUCKET = 500

_FLIP = mixed(np.arange(1, BANDS * ROWS + 1, dtype=U))[:, None]
_TIMES = mixed(np.arange(1, BANDS * ROWS + 1, dtype=U) << U(32))[:, None] | U(1)


def shingles(text: str) -> np.ndarray:
    """Sorted hashes of a text's different word shingles, A-Z lowered; a shorter text is one shingle."""
    return shingles_of([text])[0]


def shingles_of(texts: list[str]) -> list[np.ndarray]:
    """As :func:`shingles`, for each of many texts."""
    out = []
    for raws in together([t.encode().lower() for t in texts]):
        words, first = words_of(raws)
        windows = window_hashes(words, SHINGLE)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            own = windows[a:b + 1 - SHINGLE] if b - a >= SHINGLE else window_hashes(words[a:b], b - a) if b > a else words[:0]
            own = np.sort(own)
            out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else own)
    return out


def set_digest(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: what the minima of its rows hash to."""
    least = np.full(BANDS * ROWS, U((1 << 64) - 1))
    for at in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[None, at:at + 512] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=U)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * U(0x9E3779B97F4A7C15) + row)
    return keys.view(np.int64)


def alike(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of ``a`` and ``b`` elements with ``common`` ones are similar enough."""
    return common * LEAST[1] >= (a + b - common) * LEAST[0]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # few texts at a time are taken out of Arrow
            part = batch.slice(at, 256)
            sets = shingles_of(part.column(1).to_pylist())
            keys = np.concatenate([band_keys(s) for s in sets])
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([set_digest(s) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys)),
            ], ["doc_id", "fp", "keys"])


def _same_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the set ``fp``; an id may be repeated with other texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            fps = zip(part.column(0).to_pylist(), shingles_of(part.column(1).to_pylist()))
            yield part.filter(pa.array([set_digest(s) == fp for fp, s in fps], pa.bool_()))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            found = []
            for a, b in zip(*(shingles_of(part.column(k).to_pylist()) for k in (2, 3))):
                found.append(bool(alike(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))))
            yield part.select(["fp_a", "fp_b"]).filter(pa.array(found, pa.bool_()))


def _bucket_links(table: pa.Table) -> pa.Table:
    """Links between texts of different components in one bucket, at most one less than those; all pairs are compared."""
    fps, place = np.unique(table["fp"].to_numpy(), return_index=True)
    texts = table["text"]
    sets = [s for at in range(0, len(place), 64) for s in shingles_of([texts[i].as_py() for i in place[at:at + 64].tolist()])]
    # a text without words may share a bucket with short ones, but its empty set is similar to no other
    held = np.array([len(s) > 0 for s in sets])
    fps, place, sets = fps[held], place[held], [s for s in sets if len(s)]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    values, of = np.unique(np.concatenate([*sets, np.empty(0, U)]), return_inverse=True)
    tree = np.unique(table["component"].to_numpy()[place], return_inverse=True)[1]
    seen, out = np.zeros(len(values), dtype=np.int64), []
    for i in range(len(fps) - 1):
        if (tree == tree[i]).all():
            break
        own = of[starts[i]:starts[i] + sizes[i]]
        seen[own] = 1
        common = np.add.reduceat(seen[of[starts[i + 1]:]], starts[i + 1:] - starts[i + 1])
        seen[own] = 0
        for j in (np.flatnonzero(alike(common, sizes[i], sizes[i + 1:])) + i + 1).tolist():
            if tree[j] != tree[i]:
                out.append((i, j))
                tree[tree == tree[j]] = tree[i]
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pa.table({"fp_a": fps[pairs[:, 0]], "fp_b": fps[pairs[:, 1]]})


LINK = "fp_a long, fp_b long"


def near_links(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: links between ids of ``docs(doc_id, text)`` that connect all near copies found; null ids take no part."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    marked = materialized(rows.mapInArrow(_signed, "doc_id long, fp long, keys array<long>"), "shingle-sets")
    first = materialized(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.first("keys").alias("keys")), "first-of-sets")
    named = first.select("fp", "first_id")
    equal = marked.select("doc_id", "fp").join(named, "fp").where(F.col("doc_id") != F.col("first_id"))
    keyed = materialized(first.select("fp", F.explode("keys").alias("key")), "bands")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("fp").alias("least")).where(F.col("_n") > 1)
    met = materialized(keyed.join(sizes.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key")).drop("_key"), "met")
    # the texts of all that met anyone
    needed = named.join(met.select("fp").distinct(), "fp").withColumnsRenamed({"fp": "_fp", "first_id": "_id"})
    texts = rows.join(needed, F.col("doc_id") == F.col("_id")).select(F.col("_fp").alias("fp"), "text")
    texts = materialized(texts.mapInArrow(_same_set, "fp long, text string"), "met-texts")
    side = lambda s: texts.select(F.col("fp").alias(f"fp_{s}"), F.col("text").alias(f"text_{s}"))
    pairs = materialized(met.where("fp <> least").select(F.col("fp").alias("fp_a"), F.col("least").alias("fp_b")).distinct(), "star-pairs")
    both = pairs.join(side("a"), "fp_a").join(side("b"), "fp_b").select("fp_a", "fp_b", "text_a", "text_b")
    stars = materialized(both.mapInArrow(_similar, LINK), "star-links")
    # buckets that still hold several components are compared in full
    member = components(stars.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))).withColumnRenamed("node", "fp")
    placed = materialized(met.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "placed")
    split = placed.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select(F.col("key").alias("_key"))
    open_ = placed.join(split, F.col("key") == F.col("_key"))
    parts = F.ceil(F.col("_n") / bucket).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda j: F.least(j, own).cast("long") * 1_000_000 + F.greatest(j, own),
    )
    dealt = open_.select("fp", "key", "component", F.explode(cells).alias("cell")).join(texts, "fp")
    full = materialized(dealt.groupBy("key", "cell").applyInArrow(_bucket_links, LINK), "bucket-links")
    of = lambda s: named.select(F.col("fp").alias(f"fp_{s}"), F.col("first_id").alias(s))
    near = stars.union(full).distinct().join(of("a"), "fp_a").join(of("b"), "fp_b").select("a", "b")
    return equal.select(F.col("doc_id").alias("a"), F.col("first_id").alias("b")).union(near)
