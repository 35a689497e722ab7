"""The language model against one counted in dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from songloom.llm.kneser_ney import Mapped, discounts, fit_bigrams, pair_hash, scored, token_arrays
from songloom.llm.registered import QUERIES
from tests.conftest import SMALL
from tests.llm import test_ngrams as ngrams


class Plain:
    def __init__(self, texts):
        pairs = Counter()
        for t in texts:
            words = self.tokens(t)
            pairs.update(zip(["<s>", *words], words))
        self.pairs, self.n, self.left, self.right = pairs, Counter(), Counter(), defaultdict(Counter)
        for (a, b), n in pairs.items():
            self.n[b] += n
            self.left[b] += 1
            self.right[a][min(n, 3)] += 1
        self.total = sum(self.n.values())
        of = lambda counts: [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        self.d2, self.d1 = discounts(of(pairs.values())), discounts(of(self.left.values()))
        self.context = Counter(self.n)
        self.context["<s>"] = len(texts)
        self.seen, self.taken = sum(self.left.values()), sum(self.d1[min(c, 3) - 1] for c in self.left.values())

    @staticmethod
    def tokens(text):
        return [*(text or "").encode().lower().split(), "</s>"]

    def single(self, w):
        seen, taken, c = self.seen, self.taken, self.left[w]
        own = (c - self.d1[min(c, 3) - 1]) / seen if c else 0
        return own + (taken / seen if seen else 1) / (len(self.n) + 1)

    def pair(self, a, b):
        if not self.context[a]:
            return self.single(b)
        n = self.pairs[a, b]
        given = sum(self.d2[k - 1] * m for k, m in self.right[a].items())
        return ((n - self.d2[min(n, 3) - 1] if n else 0) + given * self.single(b)) / self.context[a]

    def score(self, text):
        words = self.tokens(text)
        base = sum(math.log10((self.n[w] + 1) / (self.total + len(self.n) + 1)) for w in words)
        cache = {}
        model = sum(math.log10(cache.setdefault((a, b), self.pair(a, b))) for a, b in zip(["<s>", *words], words))
        return len(words), sum(self.n[w] > 0 for w in words), base, model


def same(row, want):
    assert (row["n_tokens"], row["n_known"]) == want[:2]
    assert row["base_score"] == pytest.approx(want[2], rel=1e-9)
    assert row["score"] == pytest.approx(want[3], rel=1e-9)


def test_small_texts_and_odd_rows(spark):
    train = ["a b a c", "A b", None, "", "b\tb b b c a d", "a b a b a b a c d e f", "x y x y x"]
    model = fit_bigrams(spark.createDataFrame([(t,) for t in train], "text string"))
    plain = Plain(train)
    texts = train + ["new words a b", "long " * 50_000, "a b", "a b"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    rows = {r["doc_id"]: r for r in scored(docs, model).collect()}
    assert model.tokens == plain.total and len(rows) == len(texts)
    for i, t in enumerate(texts):
        same(rows[i], plain.score(t))
    for context in ("<s>", b"a", b"b", b"unseen"):
        assert sum(plain.pair(context, w) for w in [*plain.n, b"unknown"]) == pytest.approx(1)
    nothing = fit_bigrams(docs.limit(0))
    assert scored(docs.limit(0), nothing).count() == 0
    assert scored(docs, nothing).where("score is null or isnan(score)").count() == 0


def test_query(spark):
    """Columns that don't depend on the order, for every text; scores of order 3 are held in test_ngrams."""
    rows = {r["doc_id"]: r for r in QUERIES["op6_kneser_ney"](spark, SMALL).collect()}
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    plain = Plain([t for i, t in texts.items() if not held[i]])
    three = ngrams.Plain([t for i, t in texts.items() if not held[i]], 3)
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        words = plain.tokens(t)
        assert (rows[i]["n_tokens"], rows[i]["n_known"]) == (len(words), sum(plain.n[w] > 0 for w in words))
        base = sum(math.log10((plain.n[w] + 1) / (plain.total + len(plain.n) + 1)) for w in words)
        assert rows[i]["base_score"] == pytest.approx(base, rel=1e-9)
        assert rows[i]["held_out"] == held[i] and rows[i]["train_tokens"] == plain.total
        if len(words) < 400:
            assert rows[i]["score"] == pytest.approx(three.score(t), rel=1e-9)


def test_a_missing_array_is_an_error(spark):
    model = fit_bigrams(spark.createDataFrame([("a b c a b",)], "text string"))
    with pytest.raises(FileNotFoundError):
        Mapped("/nowhere", model.buckets, model.files)._array(next(iter(model.files)))
    assert Mapped(model.folder, model.buckets, model.files)._array("pair-99-hash") is None


def test_arrays_are_sorted_and_mapped(spark):
    model = fit_bigrams(spark.createDataFrame([("a b c a b",)], "text string"))
    mapped = Mapped(model.folder, model.buckets, model.files)
    found = [mapped._array(f"pair-{k}-hash") for k in range(model.buckets)]
    found = [x for x in found if x is not None]
    assert sum(map(len, found)) == 5 and all((np.diff(x) > 0).all() for x in found)
    assert all(isinstance(x, np.memmap) for x in found)
    tokens, sizes = token_arrays(["a b"])
    assert sizes.tolist() == [3] and len(np.unique(pair_hash(tokens[:1], tokens[1:2]))) == 1
