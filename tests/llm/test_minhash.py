"""Near copies against the exact similarity of all pairs."""

import random

import corpus_pipeline
from songloom.llm.minhash import near_links
from songloom.llm.simhash import near_copies
from tests.conftest import SMALL


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else {()}


def similarity(a, b):
    return len(a & b) / len(a | b)


def plain_components(texts):
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}
    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and similarity(sets[a], sets[b]) >= 0.8:
                i, j = sorted((root(a), root(b)))
                up[j] = i
    return {i: root(i) for i in sets}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_copies_from_similarity_080_on(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts, near, far = {}, [], []
    for least in (0.72, 0.80, 0.85, 0.90, 0.95):
        for n in (200, 400, 2_000):
            for _ in range(20):
                words = [word() for _ in range(n)]
                copy, own = list(words), plain_shingles(" ".join(words))
                while True:  # edits as long as the similarity stays
                    at, before = rng.randrange(n), list(copy)
                    copy[at] = word()
                    if similarity(own, plain_shingles(" ".join(copy))) < least:
                        break
                i = len(texts)
                texts |= {i: " ".join(words), i + 1: " ".join(before)}
                (near if least >= 0.8 else far).append(i)
    found = dict(near_copies(frame(spark, texts)).collect())
    assert sum(found.get(i + 1) == i for i in near) >= len(near) - 1
    assert not any(i in found for i in far)


def test_stage_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).toPandas())
    texts = dict(docs.select("doc_id", "text").collect())
    want = {i for i, c in plain_components(texts).items() if i == c}
    got = dict(corpus_pipeline.STAGES[2][1](spark, docs, SMALL).select("doc_id", "text").collect())
    assert got == {i: texts[i] for i in want}


def test_large_buckets_chains_and_repeated_ids(spark):
    rng = random.Random(3)
    texts = {}
    for k in range(4):
        words = [f"w{k}x{i}" for i in range(60)]
        for _ in range(40):  # a random walk: many pairs of a bucket are too far apart, neighbours are not
            texts[len(texts)] = " ".join(words)
            words[rng.randrange(60)] = f"n{len(texts)}"
    want = plain_components(texts)
    for bucket in (500, 7):
        links = near_links(frame(spark, texts), bucket).collect()
        up = {i: i for i in texts}
        def root(i):
            while up[i] != i:
                i = up[i]
            return i
        for a, b in links:
            i, j = sorted((root(a), root(b)))
            up[j] = i
        assert {i: root(i) for i in texts} == want
    twice = [(1, "one two three four five six"), (1, "entirely other words stand in here"), (2, "Entirely OTHER words stand in here"), (3, None), (4, " \n"), (None, "one two three four five six")]
    found = near_copies(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    assert sorted(found) == [(1, 1), (2, 1), (3, 3), (4, 3)]
