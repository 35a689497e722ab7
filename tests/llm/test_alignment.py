"""Token alignment against a plain version: two library tokenizers, byte ranges compared one by one."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from songloom.llm import alignment
from songloom.llm.alignment import align_tokens, aligned_ends, merge_path
from songloom.llm.bpe import byte_characters
from songloom.llm.registered import QUERIES
from tests.conftest import SMALL

PATHS = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), public.PATTERN
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


@pytest.fixture(scope="module")
def plain():
    """Expected columns of a list of texts."""
    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    back = {c: b for b, c in enumerate(byte_characters())}

    def spans(tokens):
        at = 0
        for t in tokens:
            yield at, at + len(t)
            at += len(t)

    def one(text):
        if not text:
            return [], [], "", 0
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        bytes_a = [bytes(back[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in b)]
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return [], [], "", 0
        spans_a, spans_b = list(spans(bytes_a)), list(spans(bytes_b))
        ends = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        links, j = [], 0
        for i, (s, e) in enumerate(spans_a):
            while spans_b[j][1] <= s:
                j += 1
            k = j
            while k < len(spans_b) and spans_b[k][0] < e:
                links.append((a[i], b[k]))
                k += 1
        groups, low = [], 0
        for end in ends:
            part = lambda ids, own: ",".join(str(x) for x, (s, e) in zip(ids, own) if low <= s and e <= end)  # noqa: B023, E731
            groups.append(f"{part(a, spans_a)}|{part(b, spans_b)}" if len(ends) < 400 else None)
            low = end
        return (a, b), links, ";".join(groups) if None not in groups else None, len(ends)

    def many(texts):
        rows = [one(t) for t in texts]
        held = Counter(p for _, links, _, _ in rows for p in set(links))
        best = {}
        for (a, _), n in held.items():
            best[a] = max(n, best.get(a, 0))
        return [
            (*(map(len, ids) if links else (0, 0)), n, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), groups)
            for ids, links, groups, n in rows
        ]

    return many


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(1, 9))
def test_pieces_equal_the_whole(a, b, work):
    a, b = np.array(sorted(a | {61})), np.array(sorted(b | {61}))
    links_a, links_b, group_a, group_b, closes_a, closes_b = aligned_ends(a, b, work)
    ranges = lambda x: list(zip([0, *x[:-1].tolist()], x.tolist()))
    want = {(i, j) for i, (s, e) in enumerate(ranges(a)) for j, (t, f) in enumerate(ranges(b)) if s < f and t < e}
    assert len(links_a) == len(want) and set(zip(links_a.tolist(), links_b.tolist())) == want
    both = sorted(set(a.tolist()) & set(b.tolist()))
    for own, group, closes in ((a, group_a, closes_a), (b, group_b, closes_b)):
        assert group.tolist() == [sum(x < e for x in both) for e in own.tolist()]
        assert closes.tolist() == [e in both for e in own.tolist()]
    cuts = [sum(x) for x in zip(*merge_path(a, b, work))]
    assert all(y - x == work for x, y in zip(cuts[:-2], cuts[1:-1])) and cuts[-1] - cuts[-2] <= work


def test_query_equals_plain(spark, plain):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op11_token_alignment"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for doc, want in zip(docs, plain([d["text"] for d in docs])):
        row = got[doc["doc_id"]]
        assert tuple(row[f] for f in FIELDS[:-1]) == want[:-1], doc["doc_id"]
        if want[-1] is not None:
            assert row["groups_sha256"] == (hashlib.sha256(want[-1].encode()).hexdigest() if want[-1] else "")


def test_odd_texts(spark, plain, monkeypatch):
    texts = [
        None, "", " ", "\n\t  x", "  two  spaces ", "a▁b", "▁", "<|endoftext|> </s> <s> <unk> <0x41>", "日本語 テキスト 👩‍👩‍👧‍👦",
        "\x00\x01", "a" * 3000, "don't WE'LL 12345 ½", "é́ ﬁ ǅ", "same text", "same text", "x y　z", "naïve " * 40,
    ]
    docs = spark.createDataFrame(
        [(i, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, groups string, _slice int"
    ).repartition(3)
    got = {r["doc_id"]: r for r in align_tokens(docs, *PATHS).collect()}
    want = plain(texts)
    for i, row in enumerate(want):
        assert tuple(got[i][f] for f in FIELDS)[:6] == row[:6], texts[i]
        assert row[6] is None or got[i]["groups"] == row[6]
        assert got[i]["_slice"] == i


def test_slices_and_long_texts(plain):
    """Slices of any size give the same columns; pieces cut long texts many times."""
    texts = ["the cat sat on the mat. " * 900, "", "x y z" * 50, "Über Straße " * 2000]
    both = alignment.Pair(*PATHS)
    columns, pairs, holders = both.aligned(texts, False)
    for k, t in enumerate(texts):
        own, own_pairs, _ = both.aligned([t], False)
        for c in ("n_a", "n_b", "n_groups", "n_links", "groups", "_times"):
            assert own[c][0] == columns[c][k]
        assert set(own_pairs.tolist()) <= set(pairs.tolist())
    assert [s for s in alignment._slices([3 << 20, 2 << 20, 9 << 20, 1, 1])] == [(0, 1), (1, 2), (2, 3), (3, 5)]
    assert list(alignment._slices([])) == []


def test_empty_table(spark):
    assert align_tokens(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0
