"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from songloom.llm import bpe
from songloom.llm.bpe import bpe_decode, bpe_encode, token_count, unpacked_ids
from songloom.llm.registered import QUERIES, tokenizer
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def library():
    path, pattern = tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_library(spark, library):
    got = {r["doc_id"]: r for r in QUERIES["op1_byte_bpe"](spark, SMALL).collect()}
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = library.encode_ordinary(text or "")
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_odd_texts(spark, library):
    texts = [
        None, "", " ", "\n\n  \t x", "a" * 5000, "ab" * 30_000, "  lead", "don't can't WE'LL", "日本語 テキスト", "👩‍👩‍👧‍👦🏳️‍🌈",
        "\x00\x01▁ ▁x", "Ġlit Ċ", "x y　z", "1234567890" * 50, "<|endoftext|>", "é" * 999, "same", "same",
    ]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    done = bpe_decode(bpe_encode(docs, *tokenizer()), tokenizer()[0])
    rows = {r["doc_id"]: r for r in unpacked_ids(done.withColumn("n", token_count(done["ids"]))).collect()}
    for i, t in enumerate(texts):
        assert rows[i]["ids"] == library.encode_ordinary(t or ""), t
        assert bytes(rows[i]["decoded"]) == (t or "").encode()
        assert rows[i]["n"] == len(rows[i]["ids"])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_decode(bpe_encode(docs, *tokenizer()), tokenizer()[0]).count() == 0


def test_batches_are_cut_as_by_the_pattern(library, monkeypatch):
    """The pattern's matches are found over a whole batch, without running it on each text."""
    rng, encoder = random.Random(1), bpe.Encoder(*tokenizer())
    split, encoder.split = encoder.split, None
    some = [*"aabRE''''stmdrvel19é日ñ£½²Ⅷ٣_-. \n\t 　 \x1c\x85\x00́👩", "'re", "'ll", " '", "'s", "  ", "   "]
    for _ in range(60):
        texts = ["".join(rng.choices(some, k=rng.randint(0, 40))) for _ in range(rng.randint(0, 40))]
        batch = pa.array(["zz", *texts, "zz"]).slice(1, len(texts))
        parts, first = encoder._cut(batch)
        own = [p.decode() for p in parts.to_pylist()]
        assert [own[a:b] for a, b in zip(first[:-1], first[1:])] == [split(t) for t in texts]
        ids = encoder.encode(batch)
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == [library.encode_ordinary(t) for t in texts]
        assert encoder.decode(ids).to_pylist() == [t.encode() for t in texts]


def test_other_patterns_are_run():
    encoder = bpe.Encoder(tokenizer()[0], r"\p{L}+|\s+")
    ids = encoder.encode(pa.array(["ab, cd", "", "1"]))
    assert encoder.decode(ids).to_pylist() == [b"ab cd", b"", b""]


def test_frequent_words_stay_remembered(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    encoder, learned = bpe.Encoder(*tokenizer()), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda parts: learned.extend(parts) or learn(parts))
    for k in range(100):
        encoder.encode(pa.array([f"often zq{'abcdefghij'[k % 10]}x{'klmnopqrst'[k // 10]}y", "often " * 50]))
    assert learned.count(b" often") == 1 and len(learned) < 200
    assert len(encoder.known) <= 40 and len(encoder.older) <= 40
