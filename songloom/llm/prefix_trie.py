"""The trie of conversation prefixes, summed up through minimal-perfect-hash node tables.

A node is a sequence of turns that some conversation starts with, named by a
128-bit digest: the XOR of a hash of each turn and its depth. XOR has no order,
so running digests come from slices of a conversation and one value per slice
before; a conversation of any length spreads over many tasks.

Rows lie in sorted slices, the shards. Each enumerates its distinct digests and
gives each a slot by a minimal perfect hash, checked against the digest stored
there. Counts are scattered into flat arrays by slot, merged over the shards by
digest, and every node is then dealt to the one shard that holds its smallest
member. There its values climb through the array of parent slots, deepest first.
The one conversation that a slice may continue from the slice before is kept as
a chain of its own; what it carries over a slice's edge is a row per slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from songloom.functions.ordering import range_slices
from songloom.llm.arrays import U, mixed
from songloom.llm.shared import crc, whole_text
from songloom.session import materialized

# Places per key and level of the perfect hash.
ROOM = 2
LEVELS = 64
WORDS = r"[^\x20\x09-\x0D]+"


class NodeTable:
    """Minimal perfect hash of distinct ``(depth, first, second)`` keys, with the keys stored at their slots.

    Level by level, keys that meet no other in their place take it; the rank of a
    taken place among all is the slot.
    """

    def __init__(self, depth: np.ndarray, first: np.ndarray, second: np.ndarray):
        self.levels: list[np.ndarray] = []
        left = np.arange(len(first))
        owner = []
        for level in range(LEVELS):
            if not len(left):
                break
            place = self._places(depth[left], first[left], second[left], level, size := ROOM * len(left))
            alone = np.bincount(place, minlength=size) == 1
            hit = alone[place]
            at = np.full(size, -1)
            at[place[hit]] = left[hit]
            owner.append(at[alone])
            self.levels.append(alone)
            left = left[~hit]
        if len(left):
            raise ValueError("keys must be distinct")
        order = np.concatenate(owner) if owner else left
        self.depth, self.first, self.second = depth[order], first[order], second[order]
        self.ranks, before = [], 0
        for alone in self.levels:
            self.ranks.append(before + np.cumsum(alone) - 1)
            before += int(alone.sum())

    @staticmethod
    def _places(depth, first, second, level: int, size: int) -> np.ndarray:
        h = mixed(first + mixed(second + mixed(depth.astype(U) * U(LEVELS) + U(level))))
        return (h % U(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.first)

    def slots(self, depth: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the key stored there is another: a key that is not in the table."""
        out, left = np.full(len(first), -1), np.arange(len(first))
        for level, (alone, rank) in enumerate(zip(self.levels, self.ranks)):
            place = self._places(depth[left], first[left], second[left], level, len(alone))
            taken = alone[place]
            out[left[taken]] = rank[place[taken]]
            left = left[~taken]
        at = np.maximum(out, 0)
        same = (self.depth[at] == depth) & (self.first[at] == first) & (self.second[at] == second) if len(self) else np.zeros(len(first), bool)
        return np.where(same, out, -1)


def _climb(values: np.ndarray, depth: np.ndarray, parent: np.ndarray) -> None:
    """Add every value to all slots above, deepest first."""
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))
    for d in range(len(cuts) - 2, 0, -1):
        own = order[cuts[d]:cuts[d + 1]]
        np.add.at(values, parent[own], values[own])


LOCAL = "_slice int, slot long, parent long, depth long, p1 long, p2 long, n long, ends long, least long, words long, chained boolean, top boolean, tail_of long"
LOCAL_FIELDS = [c.split()[0] for c in LOCAL.split(", ")]


def _shard(rows: pa.Table) -> pa.Table:
    """The node table of one slice: a row per slot, counts of its rows, and the slot of the parent.

    The rows of a conversation begun in an earlier slice come last, as a chain
    that ``top`` starts. ``tail_of`` names the conversation of the last row, at its slot.
    """
    rows = rows.sort_by([("c", "ascending"), ("d", "ascending")])
    c, depth, words, ends = (rows[x].to_numpy(zero_copy_only=False) for x in ("c", "d", "words", "ends"))
    p1, p2, q1, q2 = (rows[x].to_numpy().view(U) for x in ("p1", "p2", "q1", "q2"))
    chain = int((c == c[0]).sum()) if depth[0] else 0
    own, first = slice(chain, None), slice(0, chain)
    order = np.lexsort((p2[own], p1[own], depth[own])) + chain
    keys = depth[order], p1[order], p2[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    table = NodeTable(*(k[new] for k in keys))
    n, above = len(table), depth[own] > 0
    slot, up = table.slots(depth[own], p1[own], p2[own]), np.full(len(c) - chain, -1)
    up[above] = table.slots(depth[own][above] - 1, q1[own][above], q2[own][above])
    if (slot < 0).any() or (up[above] < 0).any():
        raise RuntimeError("a digest is not at its slot")
    parent, word, least = np.full(n, -1), np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max)
    parent[slot], word[slot] = up, words[own]
    np.minimum.at(least, slot, c[own])
    slots, one = np.arange(n + chain), np.ones(chain, dtype=np.int64)
    tail = slots == (n + chain - 1 if chain == len(c) else int(slot[-1]))
    columns = {
        "_slice": np.full(n + chain, rows["_slice"][0].as_py(), dtype=np.int32), "slot": slots,
        "parent": np.concatenate([parent, np.where(one.cumsum() > 1, np.arange(n - 1, n + chain - 1), -1)]),
        "depth": np.concatenate([table.depth, depth[first]]), "p1": np.concatenate([table.first, p1[first]]).view(np.int64),
        "p2": np.concatenate([table.second, p2[first]]).view(np.int64), "n": np.concatenate([np.bincount(slot, minlength=n), one]),
        "ends": np.concatenate([np.bincount(slot, ends[own], n).astype(np.int64), ends[first].astype(np.int64)]),
        "least": np.concatenate([least, c[first]]), "words": np.concatenate([word, words[first]]), "chained": slots >= n,
        "top": (slots == n) & (chain > 0), "tail_of": pa.array(np.full(n + chain, c[-1]), mask=~tail),
    }
    return pa.table({name: pa.array(columns[name]) for name in LOCAL_FIELDS})


SUMS = "depth long, p1 long, p2 long, leaves long, saved long, children long, conv_id long, n_convs long, parent_conv_id long"


def _summed(rows: pa.Table) -> pa.Table:
    """The sums of one shard's slots over all below, from the values of the nodes that are dealt to it."""
    rows = rows.sort_by("slot")
    get = lambda name: rows[name].to_numpy(zero_copy_only=False)
    filled = lambda name: rows[name].fill_null(0).to_numpy()
    depth, parent, own, least = get("depth"), get("parent"), get("owned"), get("least_of_all")
    leaves, saved = filled("leaf") + filled("up_leaf"), filled("own_saved") + filled("up_saved")
    children = filled("up_child")
    below = own & (parent >= 0)
    np.add.at(children, parent[below], 1)
    trie = int(len(depth) - get("chained").sum())
    for values in (leaves, saved):
        values[trie:] = values[trie:][::-1].cumsum()[::-1]
        _climb(values[:trie], depth[:trie], parent[:trie])
    parent_conv = np.where(parent >= 0, least[np.maximum(parent, 0)], filled("edge_parent"))
    only = lambda values, keep: pa.array(values, pa.int64(), mask=~keep)
    return pa.table({
        "depth": rows["depth"], "p1": rows["p1"], "p2": rows["p2"], "leaves": pa.array(leaves), "saved": pa.array(saved),
        "children": pa.array(children), "conv_id": only(least, own), "n_convs": only(get("n_of_all"), own),
        "parent_conv_id": only(parent_conv, own & (depth > 0)),
    })


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members that end at a node, as text in pieces: rows come sorted by node and member."""
    key = ["depth", "p1", "p2"]
    for batch in batches:
        cols, ids = [batch.column(c).to_numpy() for c in key], batch.column("c").to_pylist()
        new = np.ones(len(ids), dtype=bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in cols], axis=0)
        starts = np.flatnonzero(new)
        text = [",".join(map(str, ids[i:k])) for i, k in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)])]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(x[starts]) for x in cols], pa.array([ids[i] for i in starts], pa.int64()), pa.array(text, pa.string())], [*key, "c", "text"]
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's member list, fed piece by piece as the sorted rows pass."""
    key, digest = None, None

    def row(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [*[pa.int64()] * 3, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["depth", "p1", "p2", "ends_sha256"])

    for batch in batches:
        done = []
        for *own, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "p1", "p2", "text"))):
            if own != key:
                if key:
                    done.append((*key, digest.hexdigest()))
                key, digest = own, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        yield row(done)
    if key:
        yield row([(*key, digest.hexdigest())])


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``(c, t, k1, k2, words)``: two hashes of role and text stand for them from here on."""
    who, said = whole_text(conversations, role), whole_text(conversations, text)
    return conversations.select(
        F.col(conv_id).cast("long").alias("c"), F.col(turn).cast("long").alias("t"), F.xxhash64(who, said).alias("k1"),
        F.xxhash64(F.lit("second"), said, who).alias("k2"), F.regexp_count(said, F.lit(WORDS)).cast("long").alias("words"),
    ).where(F.col("c").isNotNull())


def _positions(turns: DataFrame) -> DataFrame:
    """``turns`` with ``pos``, the place in the conversation from 0: null turns first, ties by hash."""
    sliced = range_slices(turns, ["c", "t", "k1", "k2"])
    before = W.partitionBy("c").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    earlier = sliced.groupBy("c", "_slice").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(before))
    # only the first conversation of a slice has earlier turns: one row per slice at most
    edges = earlier.where("_before > 0").select(F.col("c").alias("_c"), F.col("_slice").alias("_s"), "_before")
    inside = F.row_number().over(W.partitionBy("c", "_slice").orderBy("t", "k1", "k2"))
    return (
        sliced.withColumn("_rn", inside).join(F.broadcast(edges), (F.col("c") == F.col("_c")) & (F.col("_slice") == F.col("_s")), "left")
        .select("c", "k1", "k2", "words", (F.col("_rn") - 1 + F.coalesce("_before", F.lit(0))).cast("long").alias("pos"))
    )


def _rebuilt(turns: DataFrame, every: int, most: int) -> DataFrame:
    """``(c, d, k1, k2, words, ends)``: the rebuilt turns from depth 1, and depth 0 for every conversation."""
    placed = materialized(_positions(turns), "turns")
    h = (crc(F.col("c").cast("string")) % most).cast("int")
    heads = (
        placed.where((F.col("c") % every == 0) & (F.col("pos") < most - 1)).groupBy(F.col("c").alias("_head"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "k1", "k2", "words"))).alias("_first"))
    )
    info = placed.groupBy("c").agg(F.count(F.lit(1)).alias("_own")).withColumn("h", h)
    info = info.join(heads, F.col("c") - F.col("c") % every == F.col("_head"), "left").withColumn(
        "taken", F.when(F.col("_first").isNull(), F.expr("slice(_first, 1, 0)")).otherwise(F.expr("slice(_first, 1, h)"))
    )
    size = F.when(F.col("taken").isNull(), 0).otherwise(F.size("taken")).cast("long")
    info = materialized(info.select(
        "c", "h", "taken", size.alias("m"), (size + F.greatest(F.col("_own") - F.col("h"), F.lit(0))).alias("total")
    ), "conversations")
    none = F.lit(0).cast("long")
    root = info.select("c", none.alias("d"), none.alias("k1"), none.alias("k2"), none.alias("words"), "total")
    head = info.select("c", F.explode("taken").alias("x"), "total").select(
        "c", (F.col("x.pos") + 1).alias("d"), "x.k1", "x.k2", "x.words", "total"
    )
    own = placed.join(info.select(F.col("c").alias("_c"), "h", "m", "total"), F.col("c") == F.col("_c")).where(F.col("pos") >= F.col("h")).select(
        "c", (F.col("pos") - F.col("h") + F.col("m") + 1).alias("d"), "k1", "k2", "words", "total"
    )
    return root.unionByName(head).unionByName(own).withColumn("ends", F.col("d") == F.col("total")).drop("total")


def _digested(rebuilt: DataFrame) -> DataFrame:
    """The rows in slices by ``(c, d)`` with the digest of each prefix, ``p1, p2``, and of the one shorter, ``q1, q2``."""
    turn = lambda *parts: F.when(F.col("d") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(*parts))
    hashed = rebuilt.select(
        "c", "d", "words", "ends", turn("d", "k1", "k2").alias("g1"), turn(F.lit("second"), "k2", "d", "k1").alias("g2")
    )
    sliced = range_slices(hashed, ["c", "d"])
    before = W.partitionBy("c").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    parts = sliced.groupBy("c", "_slice").agg(*[F.bit_xor(g).alias(f"_{g}") for g in ("g1", "g2")])
    # only the first conversation of a slice: one row per slice at most
    edges = parts.select(
        F.col("c").alias("_c"), F.col("_slice").alias("_s"), *[F.bit_xor(f"_{g}").over(before).alias(f"_b{g}") for g in ("g1", "g2")]
    ).where(F.col("_bg1").isNotNull())
    upto = W.partitionBy("c", "_slice").orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = (
        sliced.withColumns({f"_{g}": F.bit_xor(g).over(upto) for g in ("g1", "g2")})
        .join(F.broadcast(edges), (F.col("c") == F.col("_c")) & (F.col("_slice") == F.col("_s")), "left")
    )
    digest = lambda g: F.col(f"_{g}").bitwiseXOR(F.coalesce(f"_b{g}", F.lit(0).cast("long")))
    return joined.select(
        "_slice", "c", "d", "words", "ends", digest("g1").alias("p1"), digest("g2").alias("p2"),
        digest("g1").bitwiseXOR(F.col("g1")).alias("q1"), digest("g2").bitwiseXOR(F.col("g2")).alias("q2"),
    )


def _ends(rows: DataFrame) -> DataFrame:
    """``(depth, p1, p2, ends_sha256)`` of the nodes that conversations end at.

    A digest of a list needs the list in one stream; the list is written in pieces
    by all tasks, and only pieces pass through the stream.
    """
    ending = rows.where("ends").select(F.col("d").alias("depth"), "p1", "p2", "c")
    order = ["depth", "p1", "p2"]
    sliced = range_slices(ending, [*order, "c"]).drop("_slice")
    pieces = sliced.mapInArrow(_pieces, "depth long, p1 long, p2 long, c long, text string")
    streams = pieces.repartition(*order).sortWithinPartitions(*order, "c")
    return streams.select(*order, "text").mapInArrow(_digests, "depth long, p1 long, p2 long, ends_sha256 string")


def _carries(known: DataFrame) -> DataFrame:
    """What the conversation at a slice's edge gets from the slices after it and before it: two rows per slice at most."""
    chains = known.where("chained").groupBy(F.col("least").alias("c"), "_slice").agg(
        F.sum("leaf").alias("leaf"), F.sum("own_saved").alias("saved"), F.max((F.col("top") & F.col("owned")).cast("long")).alias("child"),
    )
    tails = known.where("tail_of IS NOT NULL").select(F.col("tail_of").alias("c"), "_slice", F.col("least_of_all").alias("at_edge"))
    own = chains.unionByName(tails, allowMissingColumns=True).groupBy("c", "_slice").agg(
        *[F.max(c).alias(c) for c in ("leaf", "saved", "child", "at_edge")]
    )
    order = W.partitionBy("c").orderBy("_slice")
    after = order.rowsBetween(1, W.unboundedFollowing)
    return own.select(
        F.col("c").alias("_c"), F.col("_slice").alias("_s"), F.sum("leaf").over(after).alias("up_leaf"),
        F.sum("saved").over(after).alias("up_saved"), F.lead("child").over(order).alias("up_child"), F.lag("at_edge").over(order).alias("edge_parent"),
    )


def prefix_trie(
    conversations: DataFrame, every: int = 20, most: int = 4, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: a row per node.

    Conversations are ordered by turn (null first; equal turns by a hash of role
    and text, so that the order of rows doesn't matter), null roles and texts are
    empty, rows without a conversation belong to none. Every conversation ``c`` is rebuilt:
    the first ``h`` original turns of conversation ``c - c % every``, then its own
    after its first ``h``; ``h`` is ``crc32(c) % most``. Nodes are the distinct
    prefixes of the rebuilt turns, from the one without a turn; named by the smallest member and the
    depth. ``saved_tokens`` sums (members - 1) times the words of the last text
    over the subtree; ``ends_sha256`` is taken over the members that end at the
    node. A table without conversations has no nodes. Nodes are told apart by depth and 128 bits.
    """
    rows = materialized(_digested(_rebuilt(_turns(conversations, conv_id, turn, role, text), every, most)), "prefixes")
    local = materialized(rows.groupBy("_slice").applyInArrow(_shard, LOCAL), "node-tables")
    key = ["depth", "p1", "p2"]
    nodes = local.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(
        F.sum("n").alias("n_of_all"), F.sum("ends").alias("ends_of_all"), F.min("least").alias("least_of_all")
    )
    owned = F.col("least") == F.col("least_of_all")  # the one slot of a node that holds its smallest member
    known = materialized(local.join(nodes, [F.col(k) == F.col(f"_{k}") for k in key]).select(
        "_slice", "slot", "parent", *key, "chained", "top", "tail_of", "least", "least_of_all", "n_of_all", owned.alias("owned"),
        F.when(owned & (F.col("ends_of_all") == F.col("n_of_all")), 1).otherwise(0).cast("long").alias("leaf"),
        F.when(owned, (F.col("n_of_all") - 1) * F.col("words")).otherwise(0).alias("own_saved"),
    ), "nodes")
    edge = F.coalesce("tail_of", F.when(F.col("top"), F.col("least")))
    carried = known.join(F.broadcast(_carries(known)), (F.col("_slice") == F.col("_s")) & (edge == F.col("_c")), "left").drop("_s", "_c")
    sums = carried.groupBy("_slice").applyInArrow(_summed, SUMS)
    done = sums.unionByName(_ends(rows), allowMissingColumns=True).groupBy(*key).agg(
        *[F.max(c).alias(c) for c in ("conv_id", "parent_conv_id", "n_convs")], F.sum("children").alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"),
    )
    return done.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
