"""The corpus pipeline, stage by stage and as a whole, against plain versions."""

import hashlib
from collections import Counter

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from songloom.llm.decontamination import allowed_edits, best_place, item_words
from tests.conftest import SMALL
from tests.llm.test_bpe import library  # noqa: F401  (a fixture)


def plain_stages(docs, items, library):
    """What each stage keeps, as {id: text}, from what the language stage kept."""
    lines = {i: t.split("\n") for i, t in docs.items()}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower()
    held = Counter(k for ls in lines.values() for k in {key(x) for x in ls} if k)
    docs = {i: "\n".join(x for x in ls if held[key(x)] < 10) for i, ls in lines.items()}
    yield docs
    # exact similarity of five-word shingles, over all pairs
    ids = sorted(docs)
    words = [docs[i].encode().lower().split() for i in ids]
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    same = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    near = [np.array([j for j, other in enumerate(sets) if same(own, other)]) for own in sets]
    comp, moved = np.arange(len(ids)), True
    while moved:
        low = np.array([comp[n].min() for n in near])
        moved, comp = not (low == comp).all(), low
    docs = {i: docs[i] for k, i in enumerate(ids) if comp[k] == k}
    yield docs
    out = {}
    for i, t in docs.items():
        words = item_words(t).tolist()
        leaks = (best_place(p, words)[0] <= allowed_edits(len(p), 0.8) for p in items if len(set(p) & set(words)) > len(set(p)) // 4)
        if not any(leaks):
            out[i] = t
    yield out
    yield {i: hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest() for i, t in out.items()}


def test_stages_and_run(spark, library):  # noqa: F811
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, docs
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        kept = spark.createDataFrame(stage(spark, kept, SMALL).toPandas())
        frames.append(kept)
        assert name == "tokens" or kept.columns == columns
    first = dict(frames[0].select("doc_id", "text").collect())
    assert len(first) >= 0.97 * docs.count()
    items = [item_words(r["text"]).tolist() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    *middle, last = plain_stages(first, items, library)
    for frame, want in zip(frames[1:], middle):
        assert dict(frame.select("doc_id", "text").collect()) == want
    assert dict(frames[-1].select("doc_id", "ids_sha256").collect()) == last
    assert frames[-1].where("not decodes").count() == 0
    whole = entry.queries()["pipeline"](spark, SMALL)
    assert dict(whole.select("doc_id", "ids_sha256").collect()) == last


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "the words of a text", None, "s", 1), (4, "the words of a text", "en", "s", 1), (4, "the words of a text", "en", "s", 1), (None, "the other words are here", "en", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SMALL)
    assert sorted(kept.select("doc_id").collect(), key=str) == [(3,), (None,)]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
