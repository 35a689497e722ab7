"""Personal data against plain patterns."""

import hashlib
import random
import re

from songloom.llm.pii import BASE, personal_data, reliabilities, written
from songloom.llm.registered import QUERIES
from tests.conftest import SMALL

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    ds = [int(c) for c in reversed(digits)]
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(ds)) % 10 == 0


def plain(text):
    out = []
    for no, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), no, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_query(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op7_weak_pii"](spark, SMALL.replace("0.001", "0.01")).collect()}
    texts = dict(spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect())
    assert rows.keys() == texts.keys()
    extra = 0
    for i, t in texts.items():
        want, got = plain(t), rows[i]["spans"].split(",") if rows[i]["spans"] else []
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in BASE] == [sum(w.startswith(k + ":") for w in want) for k in BASE]
        assert set(want) <= set(got)
        for kind, a, b in (x.split(":") for x in got if x not in want):
            extra += kind == "secret"
            assert kind == "secret" and re.fullmatch("[0-9A-Fa-f]{32,}", t[int(a):int(b)])
    assert extra > 5


def test_random_and_odd_texts(spark):
    rng = random.Random(2)
    bits = ["@", ".", "+", "-", " ", "(", ")", "1", "23", "4539578763621486", "a", "b.c", "é", "😀", "x@y.z", "_", "%", "\n", "255.1.2.3", "300.1.1.1", "00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    texts += [None, "", "a@b.com_x@d.org", "7" * 60_000, "a" * 60_000 + "@", "x@y" + ".z" * 30_000, "1 " * 30_000, "+1" + "(" * 50_000, "same 1.2.3.4", "same 1.2.3.4"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    found = personal_data(docs).selectExpr("doc_id", "filter(spans, s -> s.base) spans")
    got = {r["doc_id"]: r["w"] for r in found.withColumn("w", written(found["spans"])).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == ",".join(plain(t)), t
    assert personal_data(docs.limit(0)).count() == 0
    assert personal_data(docs.limit(3)).count() == 3


def test_estimates_follow_the_reliable_labelers():
    rng, counts = random.Random(4), {}
    truth = {}
    for _ in range(4_000):
        y = rng.random() < 0.3
        good = lambda p: (1 if y else -1) if rng.random() < p else (-1 if y else 1)
        votes = (good(0.95), good(0.9), good(0.85), good(0.5), good(0.5), 0)
        counts[votes] = counts.get(votes, 0) + 1
        truth.setdefault(votes, []).append(y)
    belief, odds, share = reliabilities(counts)
    assert 0.2 < share < 0.4
    assert odds[0][1] > odds[2][1] > abs(odds[3][1]) + 0.5
    right = sum((belief[v] > 0.5) == y for v, ys in truth.items() for y in ys)
    assert right > 0.93 * 4_000
