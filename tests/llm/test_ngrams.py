"""The language model of order 3 and 4 against one counted in dictionaries."""

import math
import os
import random
from collections import Counter

import pytest

from songloom.llm.kneser_ney import discounts, fit_ngrams, scored
from songloom.llm.registered import QUERIES
from tests.conftest import SMALL


def tokens(text):
    return [*(text or "").encode().lower().split(), "</s>"]


class Plain:
    """Counts of each order; those that begin a text count as seen, others by the different words before."""

    def __init__(self, texts, order):
        self.order, seen = order, [Counter() for _ in range(order + 1)]
        for t in texts:
            words = ["<s>", *tokens(t)]
            for k in range(1, order + 1):
                seen[k].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
        del seen[1][("<s>",)]
        self.counts = [Counter() for _ in range(order + 1)]
        self.counts[order] = seen[order]
        for k in range(1, order):
            before = Counter(g[1:] for g in seen[k + 1])
            self.counts[k] = Counter({g: n if g[0] == "<s>" else before[g] for g, n in seen[k].items()})
        self.off = [None] + [discounts([sum(c == j for c in self.counts[k].values()) for j in (1, 2, 3, 4)]) for k in range(1, order + 1)]
        self.after = [Counter() for _ in range(order + 1)]
        self.taken = [Counter() for _ in range(order + 1)]
        for k in range(1, order + 1):
            for g, c in self.counts[k].items():
                self.after[k][g[:-1]] += c
                self.taken[k][g[:-1]] += self.off[k][min(c, 3) - 1]

    def p(self, context, w):
        k = len(context) + 1
        below = self.p(context[1:], w) if context else 1 / (len(self.counts[1]) + 1)
        total, c = self.after[k][context], self.counts[k][(*context, w)]
        return ((c - self.off[k][min(c, 3) - 1] if c else 0) + self.taken[k][context] * below) / total if total else below

    def score(self, text):
        words = ["<s>", *tokens(text)]
        return sum(math.log10(self.p(tuple(words[max(0, i - self.order + 1):i]), words[i])) for i in range(1, len(words)))


TRAIN = ["a b a c", "A b", None, "", "b\tb b b c a d", "a b a b a b a c d e f", "x y x y x", "a b a c d", "a b c"]


@pytest.mark.parametrize("order", (2, 3, 4))
def test_orders(spark, order):
    model = fit_ngrams(spark.createDataFrame([(t,) for t in TRAIN], "text string"), order)
    plain = Plain(TRAIN, order)
    texts = TRAIN + ["new words a b", "a b a", "c a b zz a b a c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scored(docs, model).collect():
        assert r["score"] == pytest.approx(plain.score(texts[r["doc_id"]]), rel=1e-9)
    for context in ((), ("<s>",), (b"a", b"b"), (b"<s>", b"zz")):
        context = context[-(order - 1):]
        assert sum(plain.p(context, w) for w in [*(g[0] for g in plain.counts[1]), b"unknown"]) == pytest.approx(1)


def test_query_has_two_words_of_context(spark):
    rows = QUERIES["op6_kneser_ney"](spark, SMALL).select("doc_id", "held_out", "score").collect()
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    plain = Plain([texts[r["doc_id"]] for r in rows if not r["held_out"]], 3)
    for r in rows:
        if len(texts[r["doc_id"]] or "") < 5_000:
            assert r["score"] == pytest.approx(plain.score(texts[r["doc_id"]]), rel=1e-9)


@pytest.mark.parametrize("order", (2, 3, 4))
def test_frequent_words_and_many_followers(spark, order):
    """Counts over a byte, contexts with more followers than are summed on the way, and more pairs than a block."""
    draw = random.Random(order)
    train = ["a b " + " ".join(f"w{draw.randrange(40)}" for _ in range(30)) for _ in range(300)] + ["a b c " * 400, "a b " * 300]
    model = fit_ngrams(spark.createDataFrame([(t,) for t in train], "text string"), order)
    plain = Plain(train, order)
    texts = [*train[:20], *train[-2:], "a b w1 w2 w3 zz w4", "b a w1", "w1 w2 a b c a b zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scored(docs, model).collect():
        assert r["score"] == pytest.approx(plain.score(texts[r["doc_id"]]), rel=1e-9)


def test_arrays_take_few_bytes_an_ngram(spark):
    """Where most n-grams are there once: 64-bit hashes of triples, and all sums kept by pair, took more."""
    draw = random.Random(1)
    texts = [" ".join(f"w{draw.randrange(3000)}" for _ in range(500)) for _ in range(200)]
    model = fit_ngrams(spark.createDataFrame([(t,) for t in texts], "text string"), 3)
    written = sum(os.path.getsize(f"{model.folder}/{name}") - 128 for name in os.listdir(model.folder))
    assert written < 18 * model.tokens
