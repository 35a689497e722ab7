"""Longest-processing-time shards against a plain heap."""

import heapq
import random
import zlib
from collections import defaultdict

from songloom.llm.registered import QUERIES
from songloom.llm.sharding import Schedule, lpt_shards
from tests.conftest import SMALL


def plain(sizes, shards):
    """Loads and choices of the plain heap, items in the given order."""
    heap, out = [(0, k) for k in range(shards)], []
    for size in sizes:
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
        out.append(k)
    return sorted(heap), out


def test_deals_as_the_plain_heap():
    rng = random.Random(3)
    for shards in (1, 2, 5, 16):
        counts = {size: rng.choice((1, 2, 40, 700)) for size in rng.sample(range(1, 3_000), 40)}
        schedule, sizes, given = Schedule(shards), [], defaultdict(int)
        for size in sorted(counts, reverse=True):
            for k, n in schedule.deal(size, counts[size]):
                given[size, k] += n
            sizes += [size] * counts[size]
        heap, choice = plain(sizes, shards)
        want = defaultdict(int)
        for size, k in zip(sizes, choice):
            want[size, k] += 1
        assert sorted(schedule.heap) == heap
        assert dict(given) == dict(want)


def check(rows, texts, shards):
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by_text, slots, loads = defaultdict(set), defaultdict(list), [0] * shards
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        by_text[raw].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(len(x) == 1 for x in by_text.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    groups = defaultdict(int)
    for t in texts.values():
        groups[(t or "").encode()] += len((t or "").encode()) + 1
    heap, _ = plain(sorted(groups.values(), reverse=True), shards)
    assert sorted(loads) == sorted(x for x, _ in heap)


def test_query(spark):
    rows = QUERIES["op2_lpt_shards"](spark, SMALL).collect()
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    check(rows, texts, 16)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}


def test_odd_rows(spark):
    texts = dict(enumerate([None, "", "", None, "é" * 50_000] + ["same"] * 300 + [f"t{i % 7:03}{i}" for i in range(200)]))
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, shard string").repartition(7)
    check(lpt_shards(docs, 4).collect(), texts, 4)
    twice = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (None, "b", 0)], "doc_id long, text string, size int")
    assert sorted((r["doc_id"] or 0, r["size"]) for r in lpt_shards(twice, 2).collect()) == [(0, 2), (1, 2), (1, 2)]
    assert lpt_shards(docs.limit(0), 4).count() == 0
