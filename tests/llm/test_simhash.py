"""SimHash components against brute force."""

import random

import numpy as np
import xxhash

from songloom.llm.components import components
from songloom.llm.registered import QUERIES
from songloom.llm.simhash import fingerprint_links, near_copies, near_duplicates, one_of_each
from tests.conftest import SMALL


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    """Least id reachable, from {id: fingerprint}."""
    ids = sorted(fps)
    comp = {i: i for i in ids}
    values = np.array([fps[i] for i in ids], dtype=np.uint64)
    changed = True
    near = {i: [ids[j] for j in np.flatnonzero(np.bitwise_count(values ^ np.uint64(fps[i])) <= 3)] for i in ids}
    while changed:
        changed = False
        for i in ids:
            low = min(comp[j] for j in near[i])
            if low < comp[i]:
                comp[i], changed = low, True
    return comp


def test_query_against_brute_force(spark):
    got = {r["doc_id"]: r for r in QUERIES["op10_simhash"](spark, SMALL).collect()}
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    comp = plain_components(fps)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {
        i: (f"{fps[i]:016x}", comp[i]) for i in texts
    }
    assert len(set(comp.values())) < len(comp)


def test_fingerprint_equals_jvm_hash(spark):
    row = spark.sql("select xxhash64('The é x') h").first()
    assert row["h"] % 2**64 == xxhash.xxh64_intdigest("The é x".encode(), 42)


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        at = rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 5, 20))):
            fps.add(at)
            for bit in rng.sample(range(64), rng.choice((1, 2, 3, 3, 4))):
                at ^= 1 << bit
    fps = {i: f for i, f in enumerate(sorted(fps))}
    signed = {i: f - (f >> 63 << 64) for i, f in fps.items()}
    table = spark.createDataFrame([(k, f) for f in signed.values() for k in (0, 5)], "view int, fp long")
    for bucket in (2_000, 3):
        both = [tuple(r) for r in fingerprint_links(table, bucket).collect()]
        links = [r[1:] for r in both if r[0] == 5]
        assert sorted(links) == sorted(r[1:] for r in both if r[0] == 0)
        for a, b in links:
            assert ((a ^ b) % 2**64).bit_count() <= 3
        of = {f: i for i, f in signed.items()}
        up = {i: i for i in fps}
        def root(i):
            while up[i] != i:
                i = up[i]
            return i
        for a, b in links:
            i, j = sorted((root(of[a]), root(of[b])))
            up[j] = i
        assert {i: root(i) for i in fps} == plain_components(fps)


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(4, None, 1), (2, "", 1), (7, " \n\t", 1), (3, "One two", 1), (9, "one TWO", 1), (9, "one TWO", 1), (5, long, 1), (6, long + " x", 1), (None, "one two", 1), (None, "alone é here now", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted([(r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect()], key=str)
    assert got == sorted([(4, 2), (2, 2), (7, 2), (3, 3), (9, 3), (9, 3), (5, 5), (6, 5), (None, 3), (None, None)], key=str)
    kept = sorted([r["doc_id"] for r in one_of_each(docs).collect()], key=str)
    assert kept == sorted([2, 3, 5, None, None], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0 and one_of_each(docs.limit(0)).count() == 0


def test_near_copies_are_linked_and_others_not(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, near = [], set()
    for k in range(60):
        words = [word() for _ in range(400)]
        copy = list(words)
        for at in rng.sample(range(400), rng.randint(0, 2)):
            copy[at] = word()
        half = words[:200] + [word() for _ in range(200)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(copy)), (3 * k + 2, " ".join(half))]
    found = dict(near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    linked = [k for k in range(60) if found.get(3 * k + 1) == 3 * k]
    assert len(linked) >= 54
    assert not any(i % 3 == 2 for i in found)
