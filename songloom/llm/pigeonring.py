"""Near copies by wide SimHash fingerprints with pigeonring filtering, then exact Jaccard similarity.

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more. A fingerprint has 1,152 bits, a ring of 96 segments
of twelve. At 0.8 some 15 % of the bits differ (up to 19 % for sets of five), so the
budget is 280 bits, four standard deviations above the most. Fingerprints meet on
one equal segment; from there every chain of up to eleven segments must stay
within its share of the budget, then the whole ring is compared, then the texts.

Only components matter. First each fingerprint is compared with the least that it
passes a chain with. Sets whose sizes differ by more than a fifth are no near copies, so
a bucket lies by size and a row meets those of like size only. Of those that passed any, pairs of different components are
compared in the first bucket that they share: its texts come to a task, which
gives links and never pairs, so a large group of near copies stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from songloom.llm.arrays import U, mixed
from songloom.llm.components import components
from songloom.llm.minhash import BUCKET, LEAST, LINK, _bucket_links, _same_set, _similar, set_digest, shingles, shingles_of  # noqa: F401
from songloom.llm.shared import whole_text
from songloom.session import materialized

SEGMENTS, WIDTH = 96, 12
BITS = 280
# Segments that a row has behind its key, in two words of five.
CHAIN = 10
# The most bits that the first 1, 2, .. segments of a chain may differ in.
BUDGET = [k * BITS // SEGMENTS for k in range(1, CHAIN + 2)]
# Fingerprints of a cell, on average, and the rows of a bucket from which on one meets all others at a time.
CELL, LONG = 100_000, 512
# Long buckets of which more than one in so many neighbours may pass the chain hold a group of near copies.
DENSE, NEIGHBOURS = 16, 8
# Hashes that are added up bit by bit before their bits are counted, and groups of them at once.
GROUP, GROUPS = 15, 255

_KINDS = mixed(np.arange(1, SEGMENTS * WIDTH // 64 + 1, dtype=U) << U(40))
_PLACES = (1 << np.arange(WIDTH)).astype(np.uint16)


def _added(bits: list[np.ndarray]) -> list[np.ndarray]:
    """Bitwise sums of 2^k - 1 words, binary digits from the least: pairs of sums, and a word carried into each."""
    if len(bits) == 1:
        return bits
    half = len(bits) // 2
    a, b, digit, out = _added(bits[:half]), _added(bits[half:-1]), bits[-1], []
    for x, y in zip(a, b):
        odd = x ^ y
        out.append(odd ^ digit)
        digit = x & y | odd & digit
    return [*out, digit]


def _counts(hashes: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The number of remixed hashes that each bit is set in, for groups of GROUP hashes (a column each), in binary digits."""
    own = hashes[:, :, None] + _KINDS
    spare = own >> U(30)
    own ^= spare
    own *= U(0xBF58476D1CE4E5B9)
    np.right_shift(own, U(27), out=spare)
    own ^= spare
    own *= U(0x94D049BB133111EB)
    np.right_shift(own, U(31), out=spare)
    own ^= spare
    own[~kept] = 0
    return np.stack(_added(list(own)))


def wide_fingerprints(sets: list[np.ndarray]) -> list[bytes]:
    """A bit is 1 if set in over half of the remixed hashes of a set; none are set without hashes."""
    groups = [-(-len(s) // GROUP) for s in sets]
    counts = np.zeros((len(sets), SEGMENTS * WIDTH), dtype=np.int64)
    first = np.cumsum([0, *groups])
    hashes, kept = np.zeros((first[-1], GROUP), dtype=U), np.zeros((first[-1], GROUP), dtype=bool)
    for s, a, b in zip(sets, first[:-1].tolist(), first[1:].tolist()):
        hashes[a:b].reshape(-1)[:len(s)] = s
        kept[a:b].reshape(-1)[:len(s)] = True
    weights, of = 1 << np.arange(GROUP.bit_length()), np.repeat(np.arange(len(sets)), groups)
    for at in range(0, len(hashes), GROUPS):
        digits = _counts(np.ascontiguousarray(hashes[at:at + GROUPS].T), np.ascontiguousarray(kept[at:at + GROUPS].T)).astype("<u8", copy=False)
        starts = np.flatnonzero(np.append(True, np.diff(of[at:at + GROUPS])))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), digits.shape[1]]):
            bits = np.unpackbits(np.ascontiguousarray(digits[:, a:b]).view(np.uint8), axis=2, bitorder="little")
            counts[of[at + a]] += weights @ bits.sum(axis=1, dtype=np.uint8)  # GROUPS fits a byte
    sizes = np.array([len(s) for s in sets]).reshape(-1, 1)
    return [row.tobytes() for row in np.packbits(counts * 2 > sizes, axis=1, bitorder="little")]


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    return wide_fingerprints([hashes])[0]


def segments(bits: list[bytes]) -> np.ndarray:
    """The segments of fingerprints, a row each."""
    ring = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1, bitorder="little")
    out = np.empty((len(bits), SEGMENTS), dtype=np.uint16)
    for s in range(SEGMENTS):
        out[:, s] = ring[:, s * WIDTH:(s + 1) * WIDTH] @ _PLACES
    return out


def chains(ring: np.ndarray, start: int) -> np.ndarray:
    """The segments behind ``start`` in two words, a column each."""
    out = np.zeros((len(ring), 2), dtype=U)
    for k in range(CHAIN):
        out[:, k // 5] |= ring[:, (start + 1 + k) % SEGMENTS].astype(U) << U(WIDTH * (k % 5))
    return out


def holds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the chains of ``a`` and ``b``, whose first segments are equal, stay within their shares."""
    diff = a ^ b
    fine = np.bitwise_count(diff).sum(axis=1) <= BUDGET[CHAIN]
    alive = np.flatnonzero(fine)
    total = np.zeros(len(alive), dtype=np.int64)
    for k in range(CHAIN):
        total += np.bitwise_count(diff[alive, k // 5] >> U(WIDTH * (k % 5)) & U((1 << WIDTH) - 1))
        fine[alive] &= total <= BUDGET[k + 1]
    return fine


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # few texts at a time are taken out of Arrow
            part = batch.slice(at, 256)
            sets = shingles_of(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([set_digest(s) for s in sets], pa.int64()), pa.array(wide_fingerprints(sets), pa.binary()),
                pa.array([len(s) for s in sets], pa.int32()),
            ], ["doc_id", "fp", "bits", "size"])


CELLS = "cell int, fp binary, key binary, chain binary, size binary, tree binary"


def _dealt(slices: int, whole: bool):
    """Fingerprints ``(fp, bits, tree, size)`` in cells: a segment and a range of its values, many to a row, with their chains or as a ``whole``.

    Trees are needed with the whole only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells() -> pa.RecordBatch:
            ring, (fp, tree, number) = np.concatenate(rings), (np.concatenate(c) for c in zip(*names))
            rows = []
            for s in range(SEGMENTS):
                key, chain = ring[:, s], ring if whole else chains(ring, s)
                order = np.argsort(key, kind="stable")
                at = key[order].astype(np.int64) * slices >> WIDTH
                cuts = np.searchsorted(at, np.arange(slices + 1))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    own = order[cuts[k]:cuts[k + 1]]
                    columns = [x[own].tobytes() for x in (fp, key, chain, number)]
                    rows.append((s * slices + k, *columns, tree[own].tobytes() if whole else b""))
            kinds = [pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["cell", "fp", "key", "chain", "size", "tree"])

        rings, names, size = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rings.append(segments(batch.column(1).to_pylist()))
            names.append((batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()))
            size += batch.num_rows
            if size >= (512 if whole else 4_096):
                yield cells()
                rings, names, size = [], [], 0
        if size:
            yield cells()

    return run


def _cell(table: pa.Table, kind) -> tuple:
    """The columns of a cell."""
    kinds = (("fp", np.int64), ("tree", np.int64), ("size", np.int32), ("key", np.uint16), ("chain", kind))
    fp, tree, size, key, chain = (np.frombuffer(b"".join(table[c].to_pylist()), k) for c, k in kinds)
    return fp, tree, size.astype(np.int64), key, chain.reshape(len(key), -1)


def _buckets(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each bucket starts and stops in sorted keys, and the bucket of each row."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    stops = np.append(starts[1:], len(key))
    return starts, stops, np.repeat(np.arange(len(starts)), stops - starts)


def _steps(size: np.ndarray, bucket: np.ndarray, among: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in each bucket of ``among``, whose rows lie by size, but those whose sets differ too much in size to be similar.

    All rows at once: every row meets the one 1, 2, .. places further.
    """
    own = among[bucket]
    place = bucket << 40 | np.where(own, size, 0)
    reach = np.searchsorted(place, bucket << 40 | size * LEAST[1] // LEAST[0], "right") - np.arange(len(size)) - 1
    row = np.flatnonzero(own & (reach > 0))
    # the rows that reach furthest come first, so those left are always the first ones
    row = row[np.argsort(-reach[row], kind="stable")]
    left = np.cumsum(np.bincount(reach[row])[::-1])[::-1]
    for d in range(1, len(left)):
        a = row[:left[d]]
        yield a, a + d


def _least(long: int):
    """For each fingerprint of a cell a pair with the least one of its bucket and its size that it passes the chain with."""

    def run(table: pa.Table) -> pa.Table:
        fp, _, size, key, chain = _cell(table, U)
        order = np.argsort(key.astype(np.int64) << 40 | size)
        fp, size, key, chain = fp[order], size[order], key[order], chain[order]
        starts, stops, bucket = _buckets(key)
        least, half = fp.copy(), np.ascontiguousarray(chain[:, 0])

        def may(a, b) -> np.ndarray:
            """Those that the first half of the chain leaves, few if no near copies."""
            return np.flatnonzero(np.bitwise_count(half[a] ^ half[b]) <= BUDGET[CHAIN // 2])

        large, met, left = stops - starts > long, np.zeros(len(starts)), np.zeros(len(starts))
        for a, b in islice(_steps(size, bucket, large), NEIGHBOURS):
            met += np.bincount(bucket[a], minlength=len(met))
            left += np.bincount(bucket[a[may(a, b)]], minlength=len(met))
        dense = large & (left * DENSE > met)
        for a, b in _steps(size, bucket, ~dense):
            if len(near := may(a, b)):
                low, high = np.where(fp[a[near]] < fp[b[near]], (a[near], b[near]), (b[near], a[near]))
                less = fp[low] < least[high]  # the others would change nothing
                low, high = low[less], high[less]
                good = holds(chain[low], chain[high])
                np.minimum.at(least, high[good], fp[low[good]])
        for k in np.flatnonzero(dense).tolist():
            at, to = int(starts[k]), int(stops[k])
            lows = at + np.searchsorted(size[at:to], -(-size[at:to] * LEAST[0] // LEAST[1]))
            highs = at + np.searchsorted(size[at:to], size[at:to] * LEAST[1] // LEAST[0], "right")
            alone = np.ones(len(fp), dtype=bool)
            for i in (at + np.argsort(fp[at:to])).tolist():
                if alone[i]:
                    low, high = lows[i - at], highs[i - at]
                    others = low + may(slice(low, high), i)
                    others = others[alone[others] & (fp[others] > fp[i])]
                    others = others[holds(chain[i:i + 1], chain[others])]
                    least[others] = fp[i]
                    alone[others] = False
        b = np.flatnonzero(least != fp)
        return pa.table({"fp_a": least[b], "fp_b": fp[b]})

    return run


def _open(slices: int, long: int):
    """``(key, fp)`` of fingerprints that are within the budget of one of another tree and share no bucket with it before this one."""

    def run(table: pa.Table) -> pa.Table:
        fp, tree, size, key, ring = _cell(table, np.uint16)
        s = int(table["cell"][0].as_py()) // slices
        # short buckets lie by size, long ones by tree
        order = np.lexsort((fp, np.where(np.bincount(key)[key] > long, tree, size), key))
        fp, tree, size, key, ring = fp[order], tree[order], size[order], key[order], ring[order]
        starts, stops, bucket = _buckets(key)
        asked = np.zeros(len(fp), dtype=bool)

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            fine = np.bitwise_count(a.view(U) ^ b.view(U)).sum(axis=1, dtype=np.int64) <= BITS
            alive = np.flatnonzero(fine)
            fine[alive] &= ~(a[alive if len(a) > 1 else np.zeros(len(alive), int), :s] == b[alive, :s]).any(axis=1)
            return fine

        for a, b in _steps(size, bucket, stops - starts <= long):
            asking = tree[a] != tree[b]
            a, b = a[asking], b[asking]
            good = near(ring[a], ring[b])
            asked[a[good]] = asked[b[good]] = True
        for k in np.flatnonzero(stops - starts > long).tolist():
            own = tree[starts[k]:stops[k]]
            # each row meets those of the trees behind its own
            for i, behind in enumerate(np.searchsorted(own, own, side="right").tolist(), starts[k]):
                at = starts[k] + behind
                if at < stops[k]:
                    good = at + np.flatnonzero(near(ring[i:i + 1], ring[at:stops[k]]))
                    asked[good] = True
                    asked[i] |= len(good) > 0
        return pa.table({"key": key[asked].astype(np.int64) | s << 16, "fp": fp[asked]})

    return run


def ring_links(docs: DataFrame, cell: int = CELL, long: int = LONG, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: links between ids of ``docs(doc_id, text)`` that connect all near copies found; null ids take no part.

    ``cell``, ``long`` and ``bucket`` only say how the work is cut.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    marked = materialized(rows.mapInArrow(_signed, "doc_id long, fp long, bits binary, size int"), "wide-fingerprints")
    first = materialized(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.first("bits").alias("bits"), F.first("size").alias("size")), "first-of-sets")
    named = first.select("fp", "first_id")
    equal = marked.select("doc_id", "fp").join(named, "fp").where(F.col("doc_id") != F.col("first_id"))
    slices = min(1 << WIDTH, 1 << (first.count() // cell).bit_length())

    def texts_of(fps: DataFrame) -> DataFrame:
        needed = named.join(fps, "fp").withColumnsRenamed({"fp": "_fp", "first_id": "_id"})
        some = rows.join(needed, F.col("doc_id") == F.col("_id")).select(F.col("_fp").alias("fp"), "text")
        return materialized(some.mapInArrow(_same_set, "fp long, text string").dropDuplicates(["fp"]), "met-texts")

    cells = first.select("fp", "bits", F.col("fp").alias("tree"), "size").mapInArrow(_dealt(slices, False), CELLS)
    passed = materialized(cells.groupBy("cell").applyInArrow(_least(long), LINK), "passed")
    stars = passed.groupBy("fp_b").agg(F.min("fp_a").alias("fp_a"))
    met = materialized(passed.select(F.explode(F.array("fp_a", "fp_b")).alias("fp")).distinct(), "met")
    texts = texts_of(met)
    side = lambda s: texts.select(F.col("fp").alias(f"fp_{s}"), F.col("text").alias(f"text_{s}"))
    both = stars.join(side("a"), "fp_a").join(side("b"), "fp_b").select("fp_a", "fp_b", "text_a", "text_b")
    linked = materialized(both.mapInArrow(_similar, LINK), "star-links")
    member = components(linked.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))).select(F.col("node").alias("_node"), "component")
    placed = first.join(met, "fp").join(member, F.col("fp") == F.col("_node"), "left").select("fp", "bits", F.coalesce("component", "fp").alias("component"), "size")
    placed = materialized(placed, "placed")
    cells = placed.select("fp", "bits", F.col("component").alias("tree"), "size").mapInArrow(_dealt(slices, True), CELLS)
    open_ = materialized(cells.groupBy("cell").applyInArrow(_open(slices, long), "key long, fp long"), "open")
    sizes = open_.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / bucket).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    cuts = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda j: F.least(j, own).cast("long") * 1_000_000 + F.greatest(j, own),
    )
    asked = open_.join(sizes, F.col("key") == F.col("_key")).select("fp", "key", F.explode(cuts).alias("cell"))
    asked = asked.join(placed.select("fp", "component"), "fp").join(texts, "fp")
    full = materialized(asked.groupBy("key", "cell").applyInArrow(_bucket_links, LINK), "bucket-links")
    of = lambda s: named.select(F.col("fp").alias(f"fp_{s}"), F.col("first_id").alias(s))
    near = linked.union(full).distinct().join(of("a"), "fp_a").join(of("b"), "fp_b").select("a", "b")
    return equal.select(F.col("doc_id").alias("a"), F.col("first_id").alias("b")).union(near)
