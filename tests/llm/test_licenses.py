"""License notices against plain counting, planted edits, and the SQL check."""

import random
import re

import pytest

from songloom.llm.licenses import NOTICES, PHRASES, Template, license_labels, templates
from songloom.llm.registered import QUERIES, SQL
from tests.conftest import SMALL
from tools.check import compare, connect

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    """Words, places and labels of the base phrases."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = [(i, label) for label, phrase in PHRASES for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def test_query_equals_sql(spark):
    ok, note = compare(spark, connect(SMALL), SMALL, QUERIES["op13_license_diagonals"], SQL["op13_license_diagonals"])
    assert ok, note


def test_odd_texts(spark):
    texts = [
        None, "", " ", "MIT License", "mit\n\tlicense MIT-license; mit  licence", "mit license" * 3, "the Apache License", "apache license " * 50,
        "GENERAL public license general public general public license", "mIt Kelvin K mit lİcense", "x " * 30_000 + "Apache License",
        "of the " * 5000, "license mit license", "same mit license", "same mit license",
    ]
    docs = spark.createDataFrame([(None if i == 3 else i, t, i, "clash") for i, t in enumerate(texts)], "doc_id long, text string, _row int, labels string")
    got = {r["_row"]: r for r in docs.transform(license_labels).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        row = got[i]
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == base(t), t
        assert row["labels"] == row["base_labels"] and row["score"] == (1.0 if row["n_base"] else 0.0)
        assert len(row["spans"]) == row["n_base"]
    assert got[3]["doc_id"] is None


def test_edited_notices(spark):
    """A notice with a word left out, put in or changed in the middle is found; scattered words are not."""
    rng, rows = random.Random(3), []
    for label, text in NOTICES:
        words = text.split()
        for kind in range(3):
            own = list(words)
            at = len(own) // 2
            own[at:at + (kind != 0)] = [] if kind == 2 else ["foo"]
            edited = rng.choices(["lorem", "ipsum", "the", "of"], k=40) + own + rng.choices(["dolor", "and", "of", "the"], k=40)
            rows.append((label if len(words) > 14 else None, " ".join(edited).upper()))
        shuffled = list(words)
        rng.shuffle(shuffled)
        rows.append(("", " ".join(shuffled)))
    docs = spark.createDataFrame([(i, label, t) for i, (label, t) in enumerate(rows)], "doc_id long, want string, text string")
    for r in license_labels(docs).collect():
        if r["want"]:
            assert r["labels"].split(",").count(r["want"]) == 1 and r["score"] >= 0.8, r
            span = [s for s in r["spans"] if s["label"] == r["want"]][0]
            assert abs(span["start"] - 40) <= 2
        elif r["want"] == "":
            assert r["labels"] == ""


def test_own_templates_and_empty_table(spark):
    known = [Template("x", ("a", "b", "a", "b"), True), Template("y", ("a", "b", "c"), False)]
    docs = spark.createDataFrame([(1, "a b a b a b c")], "doc_id long, text string")
    row = license_labels(docs, known).first()
    assert (row["n_base"], row["first_word"], row["last_word"], row["labels"]) == (2, 0, 2, "x,y")
    assert license_labels(docs, known, k=3).first()["n_base"] == 2
    with pytest.raises(ValueError):
        license_labels(docs, known, k=4)
    assert license_labels(docs.limit(0)).count() == 0
    assert len({t.label for t in templates()}) > 3
