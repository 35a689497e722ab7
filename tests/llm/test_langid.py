"""Language identification: held-out accuracy, codewords and odd rows."""

import math
import zlib

import numpy as np
import pytest

from songloom.llm import langid
from songloom.llm.langid import codewords, fit_languages, identified
from songloom.llm.registered import QUERIES
from tests.conftest import SMALL


def test_held_out_accuracy(spark):
    rows = QUERIES["op8_language_codes"](spark, SMALL.replace("0.001", "0.01")).collect()
    truth = dict(spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang").collect())
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    right = [r for r in held if r["lang_pred"] == truth[r["doc_id"]]]
    assert len(held) > 200 and len(right) > 0.98 * len(held), (len(right), len(held))
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["ambiguous"] for r in rows) < 0.02 * len(rows)


def test_codewords_part_all_languages():
    for n in (2, 3, 4, 6, 7, 40):
        code = codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n == 2 else 2) and (abs(code.sum(axis=0)) < n).all()
    assert codewords(1).shape == (1, 0) and codewords(0).shape == (0, 0)


def test_a_wrong_bit_is_corrected(spark):
    rows = [(w * 9, lang) for lang, w in (("a", "xyz zyx "), ("b", "klm mlk "), ("c", "pqr rqp "), ("d", "uvw wvu ")) for _ in range(3)]
    model = fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    bits = model.bits("klm klm mlk")
    assert model.decode(bits)[0] == "b"
    for k in range(len(bits)):
        flipped = bits.copy()
        flipped[k] *= -1
        assert model.decode(flipped)[0] == "b"
    assert model.decode(np.zeros(7))[2]


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "123 ### \n", "x"), (4, "abc", None), (5, "é" * 1_200_000, "x"), (5, "ab", "x")],
        "doc_id long, text string, lang_pred string",
    )
    one = fit_languages(docs.withColumn("lang", docs["lang_pred"]))
    assert one.languages == ["x"]
    got = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in identified(docs, one).collect())
    assert got == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "x", 1.0), (5, "x", 1.0), (5, "x", 1.0)]
    none = fit_languages(docs.withColumn("lang", docs["lang_pred"]).where("doc_id = 4"))
    assert {r["lang_pred"] for r in identified(docs, none).collect()} == {"und"}
    assert identified(docs.limit(0), one).count() == 0


def plain_counts(text):
    """Hashed trigrams of a text, letter by letter."""
    words = "".join(c if c.isalpha() and c.isascii() or ord(c) > 127 else " " for c in text.lower()).split()
    raw, out = (" " + " ".join(words) + " ").encode() if words else b"", {}
    for i in range(len(raw) - 2):
        place = ((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % (1 << 32)) >> 18
        out[place] = out.get(place, 0) + 1
    return out


def test_predictions_equal_a_plain_version(spark):
    """The whole query: counts, bits, trust and decoding in plain loops."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r["doc_id"]: r for r in QUERIES["op8_language_codes"](spark, SMALL).collect()}
    counts = {r["doc_id"]: plain_counts(r["text"] or "") for r in rows}
    learned = [r for r in rows if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    langs = sorted({r["lang"] for r in learned})
    code = codewords(len(langs))
    share = np.full((len(langs), 1 << 14), 0.5)
    for r in learned:
        for place, n in counts[r["doc_id"]].items():
            share[langs.index(r["lang"]), place] += n
    share /= share.sum(axis=1, keepdims=True)
    weights = [np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0)) for b in range(code.shape[1])]
    bit = lambda own, w: math.tanh(3.0 * sum(n * w[p] for p, n in own.items()) / max(1, sum(own.values())))
    bits = {i: [bit(own, w) for w in weights] for i, own in counts.items()}
    trust = np.zeros_like(code)
    for k, lang in enumerate(langs):
        own = [r["doc_id"] for r in learned if r["lang"] == lang]
        for b in range(code.shape[1]):
            trust[k, b] = (sum(bits[i][b] * code[k, b] > 0 for i in own) + 1) / (len(own) + 2)
    trust /= trust.sum(axis=1, keepdims=True)
    assert len(got) == len(rows)
    for r in rows:
        row = got[r["doc_id"]]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        far = [sum(trust[k, b] * math.exp(-code[k, b] * bits[r["doc_id"]][b]) for b in range(code.shape[1])) for k in range(len(langs))]
        assert row["score"] == pytest.approx(1 / sum(math.exp(6.0 * (min(far) - x)) for x in far), rel=1e-9)
        assert row["lang_pred"] == langs[far.index(min(far))]


@pytest.mark.parametrize("at_once", [1, 7, 1 << 15])
def test_texts_are_counted_together(monkeypatch, at_once):
    """Many texts at once give what each gives on its own; no trigram goes over from one to the next."""
    monkeypatch.setattr(langid, "AT_ONCE", at_once)
    texts = ["", "ab", "a", " ", "Été à Paris 12", "12", "##", "ΑΣ", "Σ İ", "日本 x", "ab cd", "", "z"]
    want, alone = np.zeros(1 << 14), []
    for t in texts:
        alone.append(np.zeros(1 << 14))
        for place, n in plain_counts(t).items():
            alone[-1][place] += n
        want += alone[-1]
    assert (langid.counted(texts) == want).all()
    model = langid.Model(["x", "y", "z"], np.random.default_rng(0).random((3, 1 << 14)))
    bits = model.all_bits(texts)
    for own, got in zip(alone, bits):
        assert got == pytest.approx(np.tanh(3.0 * (model.weights[:, :-1] @ own) / max(1, own.sum())), abs=1e-12)
    assert model.decoded(bits) == [model.decode(b) for b in bits]
    assert model.all_bits([]).shape == (0, 3) and model.decoded(model.all_bits([])) == []
