"""Alignment of the tokens that two tokenizers make of the same text, by merge-path partitioning.

Both tokenizers cut the same bytes, so their token ends are two sorted lists whose
merge tells everything: wherever an end of either list lies, one token of each
overlaps the bytes before it, and where both have an end, a group of tokens
closes. The merge of many documents is one walk through a grid. Diagonals of the
grid, searched by bisection, cut it into pieces of equal work that know nothing
of each other; a piece emits its overlaps and closed groups, and sums over the
pieces before it turn its group numbers into those of the whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from songloom.llm.arrays import narrow, wide
from songloom.llm.bpe import byte_characters
from songloom.llm.shared import whole_text, worker_value
from songloom.session import materialized

# Tokens of both sides in a piece of the merge.
WORK = 1 << 16
# Texts that are taken together: their bytes (a longer text is taken alone) and their number.
SLICE_BYTES = 1 << 22
SLICE_DOCS = 4096
PAIR_BITS = 40


def merge_path(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """How many values of ``a`` and of ``b`` lie before every ``work``-th step of their merge.

    Both are sorted; of equal values that of ``a`` comes first. All diagonals are
    bisected at once.
    """
    steps = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(steps - len(b), 0), np.minimum(steps, len(a))
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        first = a[middle] <= b[steps[open_] - middle - 1]
        low[open_] = np.where(first, middle + 1, low[open_])
        high[open_] = np.where(first, high[open_], middle)
    return low, steps - low


def merged_piece(a: np.ndarray, b: np.ndarray, i: slice, j: slice) -> tuple[np.ndarray, ...]:
    """Overlaps of one piece (places in ``a`` and ``b``), and which of its ends in either close a group.

    Of the other pieces it reads the one end at its edge that may equal its own.
    """
    before = j.start + np.searchsorted(b[j], a[i], "left")
    closes_a = b[np.minimum(before, len(b) - 1)] == a[i]
    upto = i.start + np.searchsorted(a[i], b[j], "right")
    closes_b = a[np.maximum(upto - 1, 0)] == b[j]
    alone = ~closes_b
    links_a = np.concatenate([np.arange(i.start, i.stop), upto[alone]])
    links_b = np.concatenate([before, np.arange(j.start, j.stop)[alone]])
    return links_a, links_b, closes_a, closes_b


def aligned_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, ...]:
    """Overlapping tokens, the group of each token, and which tokens end a group.

    ``a`` and ``b`` are strictly rising ends with the same last value. The numbers
    of groups that pieces close are summed up, which stitches the groups that
    reach over an edge.
    """
    if not len(a):
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none, none.astype(bool), none.astype(bool)
    cuts_a, cuts_b = merge_path(a, b, work)
    pieces = [
        merged_piece(a, b, slice(i, k), slice(j, m))
        for i, k, j, m in zip(cuts_a[:-1].tolist(), cuts_a[1:].tolist(), cuts_b[:-1].tolist(), cuts_b[1:].tolist())
    ]
    groups = []
    for closes in ([p[2] for p in pieces], [p[3] for p in pieces]):
        done = np.cumsum([0, *(c.sum() for c in closes)])  # closed before each piece
        groups.append(np.concatenate([n + np.cumsum(c) - c for n, c in zip(done, closes)]))
    return (
        np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]), *groups,
        np.concatenate([p[2] for p in pieces]), np.concatenate([p[3] for p in pieces]),
    )


def byte_level_ranks(path: str) -> dict[bytes, int]:
    """Bytes and ids of a byte-level BPE vocabulary in JSON, whose ids must rise with the order of its merges."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    back = {c: b for b, c in enumerate(byte_characters())}
    vocab = model["vocab"]
    order = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if order != sorted(set(order)):
        raise ValueError("ids don't rise with the merges, so they can't serve as ranks")
    return {bytes(back[c] for c in token): i for token, i in vocab.items()}


class Pair:
    """Both tokenizers in a worker; texts of the first get a leading space, the second adds it itself."""

    def __init__(self, byte_path: str, piece_path: str, pattern: str):
        self.byte_path, self.piece_path, self.pattern = byte_path, piece_path, pattern

    @cached_property
    def first(self):
        import tiktoken

        return tiktoken.Encoding("first", pat_str=self.pattern, mergeable_ranks=byte_level_ranks(self.byte_path), special_tokens={})

    @cached_property
    def second(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.piece_path)

    @cached_property
    def bytes_a(self) -> list[bytes]:
        ranks = byte_level_ranks(self.byte_path)
        out = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            out[i] = token
        return out

    @cached_property
    def bytes_b(self) -> list[bytes]:
        own = self.second
        pieces = [own.id_to_piece(i) for i in range(own.get_piece_size())]
        return [bytes([int(p[3:-1], 16)]) if own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    @cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(x) for x in own], dtype=np.int64) for own in (self.bytes_a, self.bytes_b))

    @cached_property
    def written(self) -> list[bytes]:
        """Decimal ids with the mark behind them: a comma inside a group, else the end of its first or second part."""
        sides = ((len(self.bytes_a), (b"%d,", b"%d|")), (len(self.bytes_b), (b"%d,", b"%d;")))
        return [mark % i for n, marks in sides for i in range(n) for mark in marks]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids by either; none for an empty text and where the joined bytes differ from the text's."""
        none = np.empty(0, dtype=np.int64)
        out = []
        for text, second in zip(texts, self.second.encode(texts, num_threads=1)):
            ids = (none, none)
            if text:
                first = self.first.encode_to_numpy(" " + text, disallowed_special=())
                whole = b" " + text.encode()
                if all(b"".join(map(t.__getitem__, x)) == whole for t, x in ((self.bytes_a, first.tolist()), (self.bytes_b, second))):
                    ids = first.astype(np.int64), np.array(second, dtype=np.int64)
            out.append(ids)
        return out

    def aligned(self, texts: list[str], digest: bool) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
        """Columns of the texts, and the id pairs that any of them links with the number of texts that do."""
        ids = self.encode(texts)
        n_a, n_b = (np.array([len(x[k]) for x in ids], dtype=np.int64) for k in (0, 1))
        a, b = (np.concatenate([x[k] for x in ids]) for k in (0, 1))
        links_a, links_b, group_a, group_b, closes_a, closes_b = aligned_ends(*(n[x].cumsum() for n, x in zip(self.lengths, (a, b))))
        doc_a, docs = np.repeat(np.arange(len(texts)), n_a), len(texts)
        # equal pairs of a text side by side
        linked = doc_a[links_a] << PAIR_BITS | (a[links_a] * len(self.bytes_b) + b[links_b])
        linked.sort()
        at = np.flatnonzero(np.append(True, linked[1:] != linked[:-1])) if len(linked) else np.empty(0, np.int64)
        times, doc = np.diff(np.append(at, len(linked))), linked[at] >> PAIR_BITS
        pairs, place, holders = np.unique(linked[at] & ((1 << PAIR_BITS) - 1), return_inverse=True, return_counts=True)
        cuts = np.searchsorted(doc, np.arange(docs + 1)).tolist()
        spans = list(zip(cuts[:-1], cuts[1:]))
        # the ids in order of groups, those of the first tokenizer in front
        starts_b = np.searchsorted(group_b, np.arange(len(group_b) and group_b[-1] + 1), "left")
        ends_a = np.searchsorted(group_a, np.arange(len(group_a) and group_a[-1] + 1), "right")
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[np.arange(len(a)) + starts_b[group_a]] = 2 * a + closes_a
        codes[np.arange(len(b)) + ends_a[group_b]] = 2 * (len(self.bytes_a) + b) + closes_b
        ends, names, groups = (n_a + n_b).cumsum().tolist(), self.written, []
        for start, end in zip([0, *ends[:-1]], ends):
            own = b"".join(map(names.__getitem__, codes[start:end].tolist()))[:-1]
            groups.append((hashlib.sha256(own).hexdigest() if own else "") if digest else own.decode())
        count = lambda n, of: np.bincount(of, minlength=n)
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": count(docs, doc_a[closes_a]), "n_links": count(docs, doc_a[links_a]),
            "groups": groups,
            "_at": [narrow(np.diff(place[i:k], prepend=0)) for i, k in spans], "_times": [narrow(times[i:k]) for i, k in spans],
        }, pairs, holders


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if k > start and (total + size > SLICE_BYTES or k - start == SLICE_DOCS):
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
RESULT = (*NUMBERS, "n_best", "count_sum", "groups")


def _counts(left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of a slice with the corpus-wide counts of its pairs."""
    order = np.argsort(right["pair"].to_numpy())
    total, best = right["total"].to_numpy()[order], right["best"].to_numpy()[order]
    n_best, sums = [], []
    for at, times in zip(left["_at"].to_pylist(), left["_times"].to_pylist()):
        own, n = wide(at).cumsum(), wide(times)
        n_best.append(int(n[total[own] == best[own]].sum()))
        sums.append(int((n * total[own]).sum()))
    made = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
    return pa.table({"_doc": left["_doc"], **{c: left[c] for c in (*NUMBERS, "groups")}, **made})


def align_tokens(
    docs: DataFrame, byte_path: str, piece_path: str, pattern: str, text: str = "text", digest: bool = False
) -> DataFrame:
    """``docs`` without its text, with the alignment of the tokens that two tokenizers make of it.

    The first (``byte_path``, a byte-level BPE vocabulary in JSON, pre-tokens by
    ``pattern``) encodes a space and the text, the second (``piece_path``, a
    sentencepiece model) the text, before which it puts the space itself. Strings
    of special tokens are plain text to both. Added are ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``
    (overlapping pairs of tokens), ``groups`` (``a1,a2|b1;a3|b2,b3``: the ids of each group; with
    ``digest`` its SHA-256 in hex), ``n_best`` and ``count_sum``. The count of a
    pair of ids is the number of rows that link it, over all rows; ``count_sum``
    adds it up over a row's links, ``n_best`` counts the links that no other pair
    of the same first id exceeds. Null and empty texts, and those whose bytes a
    tokenizer doesn't keep, have no tokens: zeros and an empty ``groups``. Repeated
    rows count each; columns of these names are replaced.

    Texts are encoded once, in slices of a few megabytes, and written with their
    pairs to the shared folder. Pairs then travel once per slice, summed, and
    come back to their slice with the counts.
    """
    kept = [c for c in docs.columns if c not in (text, *RESULT)]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("_none")]).alias("_doc"), whole_text(docs, text).alias("_text"),
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = worker_value(("pair", byte_path, piece_path, pattern), lambda: Pair(byte_path, piece_path, pattern))
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.binary_length(texts).to_pylist()
            for start, end in _slices(sizes):
                columns, pairs, holders = both.aligned(texts.slice(start, end - start).to_pylist(), digest)
                n = end - start
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, n), pa.array(np.full(n, number)),
                    *[pa.array(columns[c], pa.int64()) for c in NUMBERS], pa.array(columns["groups"], pa.string()),
                    *[pa.array(columns[c], pa.binary()) for c in ("_at", "_times")],
                    # the pairs of the slice go with its first row
                    *[pa.array([x.tolist(), *[None] * (n - 1)], pa.list_(pa.int64())) for x in (pairs, holders)],
                ], ["_doc", "_slice", *NUMBERS, "groups", "_at", "_times", "_pairs", "_holders"])
                number += 1

    made = StructType([
        rows.schema["_doc"], StructField("_slice", LongType()), *[StructField(c, LongType()) for c in NUMBERS],
        StructField("groups", StringType()), StructField("_at", BinaryType()), StructField("_times", BinaryType()),
    ]).add("_pairs", ArrayType(LongType())).add("_holders", ArrayType(LongType()))
    coded = materialized(rows.mapInArrow(encode, made), "aligned")
    held = (
        coded.where(F.col("_pairs").isNotNull()).select("_slice", F.explode(F.arrays_zip("_pairs", "_holders")).alias("p"))
        .select("_slice", F.col("p._pairs").alias("pair"), F.col("p._holders").alias("n"))
    )
    first_id = F.expr(f"pair div {piece_count(piece_path)}")
    totals = materialized(held.groupBy("pair").agg(F.sum("n").alias("total")), "pair-counts")
    best = totals.groupBy(first_id.alias("first")).agg(F.max("total").alias("best"))
    known = totals.withColumn("first", first_id).join(best, "first").select(F.col("pair").alias("_pair"), "total", "best")
    counted = held.join(known, F.col("pair") == F.col("_pair")).select(F.col("_slice").alias("_of"), "pair", "total", "best")
    out = StructType([made["_doc"], *[made[c] for c in (*NUMBERS, "groups")], StructField("n_best", LongType()), StructField("count_sum", LongType())])
    done = (
        coded.drop("_pairs", "_holders").groupBy("_slice").cogroup(counted.groupBy("_of")).applyInArrow(_counts, out)
    )
    return done.select(*[F.col("_doc").getField(c).alias(c) for c in kept], *RESULT)


def piece_count(piece_path: str) -> int:
    """Number of pieces of the sentencepiece model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
