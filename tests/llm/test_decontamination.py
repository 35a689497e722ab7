"""Benchmark leaks against exact edit distances everywhere."""

import random

import numpy as np

from songloom.llm import decontamination
from songloom.llm.decontamination import PART, Items, allowed_edits, best_place, edited, item_words, parts_of, walk, with_leaks
from songloom.llm.registered import QUERIES
from tests.conftest import SMALL


def plain_place(pattern, text):
    """Least distance over all stretches, by the full table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != w), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_best_place_is_exact():
    rng = random.Random(8)
    for _ in range(300):
        pattern = [rng.randint(1, 4) for _ in range(rng.randint(1, 90))]
        text = [rng.randint(1, 4) for _ in range(rng.randint(0, 120))]
        distance, end = best_place(pattern, text)
        assert distance == plain_place(pattern, text)
        assert not text or end == 0 or plain_place(pattern, text[:end]) == distance


def test_query_against_all_places(spark):
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in QUERIES["op5_edit_leaks"](spark, SMALL).collect()}
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    items = dict(spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect())
    want = {}
    for i, item in items.items():
        pattern = item_words(item).tolist()
        for d, text in texts.items():
            words = item_words(text).tolist()
            if len(set(pattern) & set(words)) > len(set(pattern)) // 4:  # fewer shared words can't be near enough
                distance, _ = best_place(pattern, words)
                if distance <= allowed_edits(len(pattern), 0.8):
                    want[d, i] = distance
    assert want and got == want


def test_edited_copies_are_found(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    items = [" ".join(word() for _ in range(rng.randint(12, 60))) for _ in range(40)]
    docs, planted = [], set()
    for d in range(400):
        words = [word() for _ in range(rng.randint(0, 200))]
        if d % 2:
            k = rng.randrange(40)
            copy = items[k].split()
            for _ in range(rng.randint(0, allowed_edits(len(copy), 0.8))):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randint(0, 1)] = rng.choice([[], [word()]])
            if best_place(item_words(items[k]).tolist(), item_words(" ".join(copy)).tolist())[0] <= allowed_edits(len(items[k].split()), 0.8):
                planted.add((d, k))
                at = rng.randint(0, len(words))
                words[at:at] = [c + rng.choice(["", "!!", ".", "###"]) for c in copy]
        docs.append((d, " ".join(words) if d % 3 else " ".join(words).upper()))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    frame = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for size in (16_000_000, 2_000):
        found = {(r["doc_id"], x["item_id"]) for r in with_leaks(df, frame, block_bytes=size).collect() for x in r["leaks"]}
        assert found <= planted and len(found) >= 0.97 * len(planted), (len(found), len(planted))


def test_walks_keep_near_windows_near():
    rng = np.random.default_rng(0)
    words = rng.integers(1, 1 << 62, (200, 40)).astype(np.uint64)
    near, far = words.copy(), rng.integers(1, 1 << 62, (200, 40)).astype(np.uint64)
    near[:, 20:] = np.roll(near[:, 20:], 1, axis=1)  # a word put in
    sizes = np.full(200, 40)
    same = lambda a: np.mean([(walk(words, sizes, r) == walk(a, sizes, r)).mean() for r in range(10)])
    assert same(near) > 0.7 and same(far) < 0.05
    assert Items([], [], 0.8).found([words[0]]) == [[]]


def test_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (3, item.upper() + "!", 0), (3, item.upper() + "!", 0), (4, "x " * 100_000 + item, 0), (None, "q1 q2 q3", 0)],
        "doc_id long, text string, leaks int",
    )
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, " ,. "), (None, "q2")], "item_id long, text string")
    got = sorted(((r["doc_id"] or 0), [(x["item_id"], x["start"], x["end"]) for x in r["leaks"]]) for r in with_leaks(docs, items).collect())
    assert [(d, len(x)) for d, x in got] == [(0, 1), (1, 0), (2, 0), (3, 3), (3, 3), (4, 3)]
    assert (7, 0, 30) in got[3][1] and (7, 100_000, 100_030) in got[5][1] and got[0][1] == [(None, 1, 2)]
    assert with_leaks(docs, items.limit(0)).where("size(leaks) > 0").count() == 0
    assert with_leaks(docs.limit(0), items).count() == 0


def test_recall_in_each_class_of_sizes():
    """Items of very different length in one block, each with all the edits allowed."""
    rng = np.random.default_rng(4)
    sizes, tries = (3, 9, 30, 55, 600, 5000), {3: 60, 9: 60, 30: 60, 55: 60, 600: 40, 5000: 6}
    words = [rng.integers(0, 1 << 40, n) for n in sizes for _ in range(30 if n < 600 else 3)]
    texts = [" ".join(f"w{x}" for x in w.tolist()) for w in words]
    ids = list(range(len(texts)))
    items = Items(ids, texts, 0.8, Items(ids, texts, 0.8).calibrated(0.98))
    noise = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    for n in sizes:
        own = [k for k in ids if len(words[k]) == n]
        docs = []
        for j in range(tries[n]):
            item = item_words(texts[own[j % len(own)]])
            docs.append(np.concatenate([noise(50), edited(item, allowed_edits(n, 0.8), rng), noise(50)]))
        found = items.found(docs)
        hits = [any(x["item_id"] == own[j % len(own)] and x["distance"] <= allowed_edits(n, 0.8) for x in found[j]) for j in range(tries[n])]
        assert np.mean(hits) >= 0.95, (n, np.mean(hits))


def test_parts():
    for n in (1, PART, PART + 1, 3 * PART, 5000):
        parts = parts_of(n)
        assert parts[0][0] == 0 and parts[-1][1] == n and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert all(PART // 2 <= b - a <= PART or n < PART for a, b in parts)
        assert sum(allowed_edits(b - a, 0.8) for a, b in parts) <= allowed_edits(n, 0.8)


def test_documents_are_looked_up_together(monkeypatch):
    """Many documents at once give what each gives alone, in a few passes; no item lies over the edge of two."""
    rng, calls = np.random.default_rng(3), []
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n)) for n in (1, 3, 12, 30, 30, 90)]
    ids = list(range(len(texts)))
    items = Items(ids, texts, 0.8, Items(ids, texts, 0.8).calibrated(0.998))
    docs, half = [], texts[4].split()
    for k in range(900):
        words = [f"n{x}" for x in rng.integers(0, 1 << 40, k % 40)]
        docs.append(" ".join(words + (texts[k % 6].split() if k % 7 == 0 else []) + words))
    docs[10:12] = [" ".join(half[:15]), " ".join(half[15:])]
    words = decontamination.words_of_texts(docs)
    assert all((a == item_words(t)).all() and len(a) == len(item_words(t)) for a, t in zip(words, docs))
    alone = [items.found([w])[0] for w in words]
    assert sum(map(len, alone)) >= 128 and not alone[10] and not alone[11]
    hashes = decontamination.window_hashes
    monkeypatch.setattr(decontamination, "window_hashes", lambda *a: calls.append(1) or hashes(*a))
    assert items.found(words) == alone and len(calls) < 20
    monkeypatch.setattr(decontamination, "LOOKED_UP", 50)
    assert items.found(words) == alone


def test_many_walks_at_once(monkeypatch):
    rng = np.random.default_rng(2)
    words = rng.integers(1, 1 << 62, (50, 30)).astype(np.uint64)
    near, sizes, repeats = words.copy(), rng.integers(1, 31, 50), rng.integers(1, 40, 50)
    near[rng.random(near.shape) < 0.3] += np.uint64(1)
    together = decontamination.walks(words, sizes, range(3, 9))
    assert all((together[:, k - 3] == walk(words, sizes, k)).all() for k in range(3, 9))
    want = [any((walk(words[i:i + 1], sizes[i:i + 1], r) == walk(near[i:i + 1], sizes[i:i + 1], r)).all() for r in range(repeats[i])) for i in range(50)]
    for most in (1, 60, 1 << 12):
        monkeypatch.setattr(decontamination, "WALKED", most)
        assert decontamination.agree(words, near, sizes, repeats).tolist() == want
    assert 5 < sum(want) < 50
