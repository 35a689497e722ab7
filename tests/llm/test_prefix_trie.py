"""The prefix trie against a plain dictionary of prefixes, and its SQL check."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from songloom.llm.prefix_trie import NodeTable, prefix_trie
from songloom.llm.registered import QUERIES, SQL
from tests.conftest import SMALL
from tools.check import compare, connect

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t for _, _, t in sorted(x)] for c, x in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - int(np.fmod(c, 20))
        turns = tuple(own.get(head, [])[:h] + turns[h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append((c, len(turns)))
    name = {node: min(c for c, _ in m) for node, m in members.items()}
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * words
    return sorted(
        (name[n], len(n), name[n[:-1]] if n else None, len(m), children[n], leaves[n], saved[n],
         hashlib.sha256(",".join(str(c) for c in sorted(c for c, t in m if t == len(n))).encode()).hexdigest())
        for n, m in members.items()
    )


def got(df):
    return sorted(map(tuple, df.collect()))


def test_query_equals_sql(spark):
    ok, note = compare(spark, connect(SMALL), SMALL, QUERIES["op12_prefix_trie"], SQL["op12_prefix_trie"])
    assert ok, note


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain(spark, seed):
    """Copies, branches, a conversation over many slices, nulls, ties of equal rows and clashing columns."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(-25, 30), *rng.sample(range(30, 4000), 60)]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", None, "a"]), rng.choice(["hi there", "", None, "a\tb  c", "é ü"])))
    for c in (400, 403, 404, 405, 406):
        rows += [(c, t, "user", f"word {t % 7 if t < 90 else c}") for t in range(150 if c != 404 else 120)]
    rows += [(None, 1, "user", "lost"), (77, None, "user", "first"), (78, 3, "user", "twice"), (78, 3, "user", "twice"), (5000, 2, None, None)]
    rng.shuffle(rows)
    rows = [(*r, 1, "x") for r in rows]
    assert got(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_turnless_and_empty(spark):
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, t, "user", "a b", 1, "x") for t in range(2)]  # no head, nothing after the first three turns
    assert got(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows) and len(plain(rows)) == 1
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_node_table():
    rng = np.random.default_rng(1)
    first, second = rng.integers(0, 1 << 40, 20_000).astype(np.uint64), rng.integers(0, 5, 20_000).astype(np.uint64)
    depth = np.arange(20_000) % 9
    table = NodeTable(depth, first, second)
    slots = table.slots(depth, first, second)
    assert sorted(slots.tolist()) == list(range(20_000))  # minimal and perfect
    assert (table.slots(depth, first + np.uint64(1), second) == -1).all()  # others are told by the stored key
    assert len(NodeTable(*[np.empty(0, np.int64)] * 3).slots(depth[:0], first[:0], second[:0])) == 0
    with pytest.raises(ValueError):
        NodeTable(np.zeros(2, np.int64), np.ones(2, np.uint64), np.ones(2, np.uint64))
