"""SimHash near-duplicates with pigeonring filtering.

The 64 bits are a ring of eight segments. If two fingerprints differ in at most
three bits, then from some segment on every chain of consecutive segments stays
within its share of the three: none in the first two, at most one up to the
fifth, two up to the seventh. So at that start two segments agree, and of the
next three at least two. Fingerprints meet on those four segments (32 bits), the
chain is checked, and only survivors get the full comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from songloom.llm.arrays import U, mixed
from songloom.llm.components import components
from songloom.llm.pigeonring import ring_links
from songloom.llm.shared import whole_text
from songloom.session import materialized

BITS = 3
SEGMENTS = 8
SHINGLE = 3
# Fingerprints that a task compares at once; a larger bucket is dealt out as pairs of parts.
BUCKET = 2_000
# The most bits that the first 1, 2, .. segments of a chain may differ in.
BUDGET = np.array([(k + 1) * BITS // SEGMENTS for k in range(SEGMENTS)])


def fingerprint(text: str, shingle: int = SHINGLE, kinds: int = 1) -> list[int]:
    """64-bit SimHashes of a text's word shingles, zero without words.

    The first takes the XXH64 of a shingle as it is, any further one a remixed hash.
    """
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return [0] * kinds
    whole, size = b" ".join(words), min(shingle, len(words))
    lengths = np.array([len(w) + 1 for w in words])
    ends = lengths.cumsum()
    starts, stops = (ends - lengths)[: len(words) - size + 1].tolist(), (ends[size - 1:] - 1).tolist()
    digest, total = xxhash.xxh64_intdigest, len(starts)
    counts = np.zeros((kinds, 64), dtype=np.int64)
    for at in range(0, total, 65_536):  # the bits of very long texts are counted in pieces
        hashes = np.array(
            [digest(whole[s:e], 42) for s, e in zip(starts[at:at + 65_536], stops[at:at + 65_536])], dtype="<u8"
        )
        for kind in range(kinds):
            own = hashes if not kind else mixed(hashes + U(kind))
            counts[kind] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > total, axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", views: tuple[tuple[int, int], ...] = ((SHINGLE, 1),)
) -> DataFrame:
    """``(doc_id, view, fp)``: the fingerprints of each row, as signed longs of the same bits.

    ``views`` lists shingle lengths and how many fingerprints of each are taken;
    views are numbered from 0. A null or empty text, or one without words, has
    fingerprint zero in all.
    """
    n = sum(kinds for _, kinds in views)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # few texts at a time are taken out of Arrow
                part = batch.slice(at, 256)
                fps = [fp for t in part.column(1).to_pylist() for shingle, kinds in views for fp in fingerprint(t, shingle, kinds)]
                rows = pa.array(np.repeat(np.arange(part.num_rows), n))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(rows), pa.array(np.tile(np.arange(n, dtype=np.int32), part.num_rows)),
                    pa.array(np.array(fps, dtype=np.uint64).view(np.int64)),
                ], ["doc_id", "view", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(docs, text).alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, view int, fp long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * (i % SEGMENTS)).bitwiseAND(F.lit(255).cast("long"))


def _keys(fp: Column) -> Column:
    """The 24 places to meet: a start of the chain, its first two segments and two of the next three."""
    out = []
    for start in range(SEGMENTS):
        for left_out in (2, 3, 4):
            parts = [_segment(fp, start + k) for k in (0, 1, 2, 3, 4) if k != left_out]
            packed = reduce(lambda a, b: F.shiftleft(a, 8).bitwiseOR(b), parts)
            out.append(F.lit((start * 8 + left_out) << 32).bitwiseOR(packed))
    return F.array(*out)


def linked(a: np.ndarray, b: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``a`` and ``b`` that differ in at most BITS bits and whose chain from ``start`` holds."""
    diff = a[:, None] ^ b[None, :]
    turn = np.uint64(8 * start)
    ring = (diff >> turn) | (diff << ((np.uint64(64) - turn) & np.uint64(63))) if start else diff
    alive = np.flatnonzero(np.bitwise_count(ring & np.uint64((1 << 40) - 1)).ravel() <= BUDGET[4])
    chain = np.bitwise_count(ring.ravel()[alive][:, None].view(np.uint8)).cumsum(axis=1)
    alive = alive[(chain <= BUDGET).all(axis=1)]
    near = alive[np.bitwise_count(diff.ravel()[alive]) <= BITS]
    return np.divmod(near, len(b))


class Forest:
    """Union of indexes; tells whether a link joins two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _bucket_links(table: pa.Table) -> pa.Table:
    """Links that join the fingerprints of one bucket, at most one less than those; never all pairs."""
    fps = np.unique(table["fp"].to_numpy()).view(np.uint64)
    start = int(table["key"][0].as_py()) >> 35 & 7
    forest, out = Forest(len(fps)), []
    for at in range(0, len(fps), 256):
        some = fps[at:at + 256]
        left, right = linked(some, fps[at:], start)
        for i, j in zip((left + at).tolist(), (right + at).tolist()):
            if i < j and forest.join(i, j):
                out.append((i, j))
    signed = fps.view(np.int64)
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    view = np.full(len(pairs), table["key"][0].as_py() >> 40, dtype=np.int32)
    return pa.table({"view": view, "fp_a": signed[pairs[:, 0]], "fp_b": signed[pairs[:, 1]]})


def fingerprint_links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``(view, fp_a, fp_b)``: links that connect all fingerprints of ``distinct(view, fp)`` within three bits.

    Only fingerprints of one view (a small number) meet. They meet in 24 buckets
    of 32 equal bits, four billion places per kind, so buckets hold near copies
    and little else. A bucket of more than ``bucket`` fingerprints is cut into
    parts, and every two parts meet in a task of their own, so any size is
    compared in full.
    """
    keys = F.transform(_keys(F.col("fp")), lambda k: k + F.shiftleft(F.col("view").cast("long"), 40))
    keyed = materialized(distinct.select("fp", F.explode(keys).alias("key")), "keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    met = keyed.join(sizes.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"))
    parts = F.ceil(F.col("_n") / bucket).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda j: F.least(j, own).cast("long") * 1_000_000 + F.greatest(j, own),
    )
    dealt = met.select("fp", "key", F.explode(cells).alias("cell"))
    return dealt.groupBy("key", "cell").applyInArrow(_bucket_links, "view int, fp_a long, fp_b long").distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET
) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per row of ``docs``.

    Fingerprints link at three or fewer differing bits; a component is named by
    its least id. Rows without words share fingerprint zero and link like any
    other. Repeated rows each get their row; a row with a null id stands for no
    component but connects the others, and gets its component too, null only
    if all ids of the component are null.
    """
    marked = materialized(fingerprints(docs, doc_id, text, ((shingle, 1),)).drop("view"), "fingerprints")
    distinct = materialized(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    # fingerprints are the nodes; the least id of a component is found afterwards
    links = fingerprint_links(distinct.select(F.lit(0).alias("view"), "fp"), bucket)
    member = components(links.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))
    named = distinct.join(member.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_fp = named.join(least, "component").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(of_fp, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame) -> DataFrame:
    """``(node, component)``: ids of documents that are near copies of others, and the least id of each component.

    Two documents are linked if their five-word shingles have a Jaccard similarity
    of 0.8 or more. Candidates are met by the pigeonring filter on wider fingerprints
    of those shingles (see :mod:`songloom.llm.pigeonring`), as the distance of 64 bits
    scatters too much for that. Null ids take no part.
    """
    return components(ring_links(docs))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies (see :func:`near_copies`): of each component the row of the least id stays.

    Of rows with equal ids any one stays; rows with a null id all stay.
    """
    gone = near_copies(docs).where(F.col("node") != F.col("component")).select(F.col("node").alias("_id"))
    left = docs.join(gone, docs["doc_id"] == F.col("_id"), "left_anti")
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return left.withColumn("_alone", alone).dropDuplicates(["doc_id", "_alone"]).drop("_alone")
