"""Repeated passages against SQL and brute force."""

import random

import numpy as np
import pytest

from songloom.llm.arrays import from_planes, picked, planes, window_hashes, word_hashes, word_spans
from songloom.llm.registered import QUERIES, SQL
from songloom.llm.substrings import ladder, without_repeats
from tests.conftest import SMALL
from tools.check import compare, connect


def plain(docs, window):
    """``{id: (n_words, n_removed, kept)}`` by comparing all windows."""
    words = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def test_query_against_sql(spark):
    ok, note = compare(spark, connect(SMALL), SMALL, QUERIES["op3_repeated_passages"], SQL["op3_repeated_passages"])
    assert ok, note


def test_arrays():
    raw = (" é x\tlong" + "w" * 300_000 + "\nx  é\x0b" + "ab " * 150_000).encode()
    starts, ends = word_spans(raw)
    assert [raw[s:e] for s, e in zip(starts, ends)] == raw.split()
    hashes = word_hashes(raw, starts, ends)
    by_word = {}
    for w, h in zip(raw.split(), hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    rng = np.random.default_rng(1)
    values = rng.integers(0, 3, 400).astype(np.uint64)
    for length in (1, 2, 3, 7, 13, 400, 401):
        h = window_hashes(values, length).tolist()
        assert len(h) == max(0, 401 - length)
        seen = {}
        for p, x in enumerate(h):
            assert seen.setdefault(tuple(values[p:p + length].tolist()), x) == x
        assert len(set(seen.values())) == len(seen)
    noise = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    chosen = set(picked(noise, 7).tolist())
    assert all(int(np.argmin(noise[p:p + 7])) + p in chosen for p in range(294)) and len(chosen) < 110
    signed = np.array([0, -1, 1 << 40, -(1 << 63)])
    assert from_planes(planes(signed)).tolist() == signed.tolist()
    assert ladder(13) == [7, 13] and ladder(50) == [7, 13, 25, 50] and ladder(3) == [3]


@pytest.mark.parametrize("window", [3, 13, 30])
def test_random_texts(spark, window):
    rng = random.Random(window)
    bank = [[rng.choice("abcdefgh") + rng.choice("xyz") * rng.randint(0, 1) for _ in range(rng.randint(5, 80))] for _ in range(12)]
    docs = []
    for i in range(60):
        words = [w for _ in range(rng.randint(0, 5)) for w in rng.choice(bank)[rng.randint(0, 9):]]
        docs.append((i // 2 if i > 50 else i, rng.choice([" ", "\n", " \t"]).join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in without_repeats(df, window).collect())
    assert got == plain(docs, window)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n ", "a"), (5, long, "a"), (6, "x " + long, "a"), (7, passage, "a"), (7, passage, "a"), (None, passage + " end", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept"], str(r["removed"])) for r in without_repeats(df).collect()}
    assert got == {
        (1, 0, 0, "", "[]"), (2, 0, 0, "", "[]"), (3, 0, 0, "", "[]"), (5, 60_000, 0, long, "[]"),
        (6, 60_001, 60_000, "x", "[Row(start=1, end=60001)]"), (7, 20, 20, "", "[Row(start=0, end=20)]"),
        (None, 21, 0, passage + " end", "[]"),
    }
    assert without_repeats(df.limit(0)).count() == 0
