"""The pipeline's near copies are met by the pigeonring filter on wide fingerprints."""

import random

import numpy as np
import pyarrow as pa

from songloom.llm import pigeonring as p
from songloom.llm.arrays import U, mixed
from songloom.llm.simhash import near_copies
from tests.llm.test_minhash import frame, plain_components


def test_sets_of_similarity_080_meet():
    rng = np.random.default_rng(5)
    for a, b, common in ((5, 4, 4), (6, 5, 5), (10, 8, 8), (45, 45, 40), (300, 300, 267)):
        found, n = 0, 300
        for _ in range(n):
            h = mixed(rng.integers(0, 1 << 63, a + b - common).astype(U))
            x, y = p.wide_fingerprint(h[:a]), p.wide_fingerprint(h[a - common:])
            differ = int(np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum())
            x, y = p.segments([x]), p.segments([y])
            met = any(x[0, s] == y[0, s] and p.holds(p.chains(x, s), p.chains(y, s))[0] for s in range(p.SEGMENTS))
            found += met and differ <= p.BITS
        assert found >= n - 2


def walks():
    rng, texts = random.Random(4), {}
    for k in range(3):
        words = [f"w{k}x{i}" for i in range(60)]
        for _ in range(30):  # neighbours are near copies, many other pairs of a bucket are not
            texts[len(texts)] = " ".join(words)
            words[rng.randrange(60)] = f"n{len(texts)}"
    return texts


def test_any_cut_of_the_work_gives_the_same(spark):
    texts = walks()
    want = plain_components(texts)
    for cell, long, bucket in ((100_000, 512, 500), (10, 2, 7)):
        up = {i: i for i in texts}
        def root(i):
            while up[i] != i:
                i = up[i]
            return i
        for a, b in p.ring_links(frame(spark, texts), cell, long, bucket).collect():
            i, j = sorted((root(a), root(b)))
            up[j] = i
        assert {i: root(i) for i in texts} == want


def test_links_come_from_the_filter(spark, monkeypatch):
    texts = walks()
    assert near_copies(frame(spark, texts)).count() > 80
    monkeypatch.setattr(p, "_least", lambda *a: lambda table: __import__("pyarrow").table({"fp_a": np.empty(0, np.int64), "fp_b": np.empty(0, np.int64)}))
    assert near_copies(frame(spark, texts)).count() == 0


def test_a_large_group_gives_links_not_pairs(spark):
    rng, base = random.Random(6), [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(300), 8):  # two copies mostly lie under 0.8, a copy and the first text over it
            words[at] = f"n{i}x{at}"
        texts[i] = " ".join(words if i else base)
    links = p.ring_links(frame(spark, texts))
    assert links.count() < 20 * len(texts)
    assert {c for _, c in near_copies(frame(spark, texts)).collect()} == {0}


def test_an_empty_set_in_a_bucket_is_near_to_no_other():
    """A fingerprint of two shingles has about a fourth of its bits, within the budget of that without any."""
    short, other, copy = "one two three four five six", "other words stand in this place", "Other WORDS stand in this place "
    fp = lambda text: p.set_digest(p.shingles(text))
    rng = random.Random(8)
    for texts in ([short, ""], [" ", other], ["", short, other], [""], ["a b", "", "c d"]):
        for _ in range(3):
            rng.shuffle(texts)
            # the empty set stands first, between and last by these names
            for names in (list(range(len(texts))), list(range(len(texts)))[::-1]):
                table = pa.table({"fp": pa.array(names, pa.int64()), "component": pa.array(names, pa.int64()), "text": texts})
                assert p._bucket_links(table).num_rows == 0
    assert fp(other) == fp(copy)
    long = " ".join(f"w{i}" for i in range(40))
    table = pa.table({"fp": [1, 2, 3], "component": [1, 2, 3], "text": [long, "", long + " end"]})
    assert p._bucket_links(table).to_pylist() == [{"fp_a": 1, "fp_b": 3}]


def test_texts_without_words_beside_short_ones(spark):
    """Many texts of two shingles reach the bucket of the empty text; only true copies are linked."""
    texts = {i: " ".join(f"w{i}x{j}" for j in range(6)) for i in range(1_500)} | {1_500: "", 1_501: " \n", 1_502: "W7X0 w7x1 w7x2 w7x3 w7x4 w7x5"}
    found = dict(near_copies(frame(spark, texts)).collect())
    assert found == {7: 7, 1_502: 7, 1_500: 1_500, 1_501: 1_500}


def test_fingerprints_of_many_sets():
    """Sets of any size, counted together, get the bits that most of their remixed hashes have."""
    rng = np.random.default_rng(9)
    sets = [rng.integers(0, 1 << 63, n).astype(U) for n in (0, 1, 2, 14, 15, 16, 0, 31, 300, 5000, 0)]
    for own, got in zip(sets, p.wide_fingerprints(sets)):
        bits = [np.unpackbits(mixed(own + k).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") for k in p._KINDS]
        assert got == np.packbits(np.concatenate([b.sum(axis=0) * 2 > len(own) for b in bits]), bitorder="little").tobytes()
    assert p.wide_fingerprints([]) == []


def plain_least(fp, size, key, chain):
    """For each fingerprint the least of its bucket and its size that it passes the chain with, over all pairs."""
    out = {}
    for j in range(len(fp)):
        near = [i for i in range(len(fp)) if key[i] == key[j] and fp[i] < fp[j] and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j])]
        near = [i for i in near if p.holds(chain[i:i + 1], chain[j:j + 1])[0]]
        if near:
            out[int(fp[j])] = int(min(fp[near]))
    return out


def test_chains_are_compared_among_like_sizes(monkeypatch):
    """Rows of a bucket that are far apart cost no whole comparison, and sets of unlike sizes do not meet."""
    rng, n = np.random.default_rng(1), 600
    fp = rng.permutation(10 * n)[:n].astype(np.int64) - 5 * n
    size, key = rng.integers(0, 40, n), rng.integers(0, 3, n).astype(np.uint16)
    chain = rng.integers(0, 1 << 60, (n, 2)).astype(U)
    for i in range(0, n, 2):  # copies that differ in a few bits, and in the number of shingles
        chain[i + 1] = chain[i] ^ U(1 << rng.integers(0, 60)) if i % 8 else chain[i]
        key[i + 1], size[i + 1] = key[i], size[i] + rng.integers(0, 12)
    chain[:60:3], key[:60] = chain[0], 1
    table = pa.table({c: [v.tobytes()] for c, v in (("fp", fp), ("tree", fp), ("size", size.astype(np.int32)), ("key", key), ("chain", chain))})
    asked, holds = [], p.holds
    monkeypatch.setattr(p, "holds", lambda a, b: asked.append(max(len(a), len(b))) or holds(a, b))
    got = p._least(4096)(table)
    assert sum(asked) < 2 * n  # some 60,000 pairs share a bucket
    monkeypatch.setattr(p, "holds", holds)
    want = plain_least(fp, size, key, chain)
    assert dict(zip(got["fp_b"].to_pylist(), got["fp_a"].to_pylist())) == want and len(want) > 100
    got = p._least(2)(table)  # long buckets without a large group are no different
    assert dict(zip(got["fp_b"].to_pylist(), got["fp_a"].to_pylist())) == want
    # in one with a large group a row that has met a lesser one leaves: the links are fewer, and of those pairs
    monkeypatch.setattr(p, "DENSE", 1 << 40)
    few = p._least(2)(table).to_pylist()
    assert 0.9 * len(want) < len(few) <= len(want) and all(r["fp_a"] >= want[r["fp_b"]] for r in few)
