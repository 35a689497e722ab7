"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose spans. Six labelers (formats, checksums, gazetteers, context,
boundaries, repetition) vote on each. Expectation-maximisation over the counts
of vote patterns estimates how reliable every labeler is and so a probability
for each pattern; a naive Bayes classifier over the shape of spans is trained on
those and decides about spans that no strict pattern settles.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from songloom.llm.shared import whole_text
from songloom.session import materialized

KINDS = ("email", "ip", "card", "phone", "secret", "number")
BASE = KINDS[:4]
# The characters that a pattern can't do without; texts that lack them are not searched.
NEEDED = {"email": "@", "ip": "[.][0-9]", "card": "[0-9]", "phone": "[+][0-9]", "secret": "[0-9A-Fa-f]{32}"}
# Written so that a search takes time in proportion to the text: possessive repeats, and
# starts only where a run of fitting characters starts or the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Gazetteers: fixed word lists.
TOP_LEVEL = "com|org|net|edu|gov|io|info|biz|de|fr|es|it|nl|uk|eu|us|ca|ch|at|be|pl|pt|se"
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
COUNTRIES = "^(?:1|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
CONTACT = "(?i)(?:mail|phone|tel|call|fax|card|address|token|key|secret|passw|credential|login)[^a-z]{0,8}$"
PUBLISHING = "(?i)(?:version|license|licence|section|chapter|page|figure|table|release)[^a-z]{0,8}$"
AROUND = 24
ROUNDS = 40
VOTES = ("format", "checksum", "gazetteer", "context", "boundary", "repetition")
SHAPE = ("kind", "length", "digits", "left", "right", "parted", "rule")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Checksum of a string of digits."""
    backward = F.reverse(digits)
    def weighed(total: Column, i: Column) -> Column:
        d = F.ascii(backward.substr(i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weighed) % 10 == 0


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, doc_id, kind, start, end, value, before, after)``: one row per proposed span.

    Rows of ``docs`` without any have one row with a null kind. Positions are
    code points, the end exclusive. ``before`` and ``after`` are the nearest
    characters around a span.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), whole_text(docs, text).alias("_text"))
    none = F.array().cast("array<struct<value:string,left:string,right:string,kind:string,no:int>>")
    found = []
    for kind, pattern in PATTERNS.items():
        matches = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
        between = F.split("_text", pattern, -1)
        n = F.size(matches)
        spans = F.arrays_zip(
            matches.alias("value"), F.slice(between, 1, n).alias("left"), F.slice(between, 2, n).alias("right"),
            F.transform(matches, lambda _: F.lit(kind)).alias("kind"), F.sequence(F.lit(1), n).alias("no"),
        )
        possible = F.col("_text").rlike(NEEDED[kind]) & (F.regexp_count("_text", F.lit(pattern)) > 0)
        found.append(F.when(possible, spans).otherwise(none))
    span = F.col("_span")
    rows = base.select("doc_id", "row", F.explode_outer(F.concat(*found)).alias("_span"))
    flat = materialized(rows.select(
        "row", "doc_id", span["kind"].alias("kind"), span["no"].alias("no"), span["value"].alias("value"),
        F.length(span["left"]).cast("long").alias("gap"), F.length(span["value"]).cast("long").alias("size"),
        F.expr(f"right(_span.left, {AROUND})").alias("before"), F.expr(f"left(_span.right, {AROUND})").alias("after"),
    ), "span-candidates")
    # the start is all that lies before: gaps up to this span and earlier spans of the kind
    until = W.partitionBy("row", "kind").orderBy("no").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(until)
    return flat.repartition("row").withColumn("end", end).select(
        "row", "doc_id", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value", "before", "after"
    )


def strict(spans: DataFrame) -> Column:
    """Whether a span meets the full rule of its kind; false for kinds without one."""
    digits = _digits(F.col("value"))
    count = F.length(digits)
    card = F.when(count.between(14, 19), passes_luhn(digits)).otherwise(False)
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", F.col("value").rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
        .when(F.col("kind") == "card", card)
        .when(F.col("kind") == "phone", count.between(10, 15))
        .otherwise(False)
    )


def voted(spans: DataFrame) -> DataFrame:
    """``spans`` with ``base`` and one column per labeler: 1 personal, -1 not, 0 no opinion."""
    kind, value, digits = F.col("kind"), F.col("value"), _digits(F.col("value"))
    yes_no = lambda c: F.when(c, 1).otherwise(-1)
    yes = lambda c: F.when(c, 1).otherwise(0)
    mixed = value.rlike("[0-9]") & value.rlike("[A-Fa-f]")
    gazetteer = (
        F.when(kind == "email", yes_no(value.rlike(rf"(?i)\.(?:{TOP_LEVEL})$")))
        .when(kind == "card", yes(digits.rlike(ISSUERS)))
        .when(kind == "phone", yes(digits.rlike(COUNTRIES)))
        .when(kind == "ip", F.when(value.rlike(r"^(?:0|10|127|255|192\.168)\."), -1).otherwise(0))
        .otherwise(yes(F.col("before").rlike(CONTACT)))
    )
    open_left, open_right = ~F.col("before").rlike("[A-Za-z0-9]$"), ~F.col("after").rlike("^[A-Za-z0-9]")
    return spans.withColumn("base", strict(spans)).withColumns({
        "format": F.when(kind == "secret", yes(F.length("value").isin(32, 40, 64))).otherwise(yes_no(F.col("base"))),
        "checksum": F.when(kind == "card", yes_no(F.col("base"))).when(kind == "secret", yes_no(mixed)).otherwise(0),
        "gazetteer": gazetteer,
        "context": F.when(F.col("before").rlike(CONTACT), 1).when(F.col("before").rlike(PUBLISHING), -1).otherwise(0),
        "boundary": yes_no(open_left & open_right),
        "repetition": F.when(value.rlike(r"([0-9A-Za-z])\1{5}"), -1).otherwise(0),
    })


def reliabilities(patterns: dict[tuple, int]) -> tuple[dict[tuple, float], list[dict[int, float]], float]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns the probability of each pattern, each labeler's log odds by vote, and
    the share of personal spans. Starts from the majority. The table has at most
    three to the power of the labelers' number rows, whatever the input.
    """
    if not patterns:
        return {}, [], 0.5
    belief = {p: 1 / (1 + math.exp(-sum(p))) for p in patterns}
    total, odds, share = sum(patterns.values()), [], 0.5
    for _ in range(ROUNDS):
        share = sum(belief[p] * n for p, n in patterns.items()) / total
        share = min(max(share, 1e-3), 1 - 1e-3)
        odds = []
        for k in range(len(VOTES)):
            yes, no = dict.fromkeys((-1, 0, 1), 1.0), dict.fromkeys((-1, 0, 1), 1.0)
            for p, n in patterns.items():
                yes[p[k]] += belief[p] * n
                no[p[k]] += (1 - belief[p]) * n
            odds.append({v: math.log(yes[v] / sum(yes.values())) - math.log(no[v] / sum(no.values())) for v in yes})
        start = math.log(share / (1 - share))
        belief = {
            p: 1 / (1 + math.exp(-max(-30.0, min(30.0, start + sum(o[v] for o, v in zip(odds, p)))))) for p in patterns
        }
    return belief, odds, share


def _shape() -> dict[str, Column]:
    """The span classifier's features, each with a bounded number of values."""
    value, size = F.col("value"), F.length("value")
    side = lambda c: F.when(c == "", "none").when(c.rlike("[A-Za-z]"), "letter").when(c.rlike("[0-9]"), "digit").when(
        c.rlike(r"\s"), "blank").when(c.rlike("[\"']"), "quote").otherwise("other")
    return {
        "kind": F.col("kind"), "length": F.least(F.floor(size / 4), F.lit(40)).cast("string"),
        "digits": F.floor(10 * F.length(_digits(value)) / size).cast("string"),
        "left": side(F.expr("right(before, 1)")), "right": side(F.expr("left(after, 1)")),
        "parted": value.rlike("[ .()-]").cast("string"),
        "rule": F.when(F.col("kind") == "secret", "none").when(F.col("base"), "met").otherwise("failed"),
    }


def trained(spans: DataFrame) -> tuple[dict[tuple[str, str], float], float]:
    """Weights of (feature, value) and the bias of the span classifier, from all voted spans.

    Sums go to the driver: at most a few hundred rows, as features are bounded.
    """
    counts = spans.groupBy(*VOTES).agg(F.count(F.lit(1)).alias("n")).collect()
    belief, _, _ = reliabilities({tuple(r[v] for v in VOTES): r["n"] for r in counts})
    if not belief:
        return {}, 0.0
    at = F.concat_ws(",", *[F.col(v).cast("string") for v in VOTES])
    known = F.create_map(*[F.lit(x) for p, b in belief.items() for x in (",".join(map(str, p)), float(b))])
    soft = spans.withColumn("_p", known[at]).withColumns({f"_{k}": c for k, c in _shape().items()})
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"_{k}").alias("value")) for k in SHAPE]))
    sums = soft.select("_p", pairs.alias("_f")).groupBy("_f.feature", "_f.value").agg(
        F.sum("_p").alias("yes"), F.sum(1 - F.col("_p")).alias("no")
    ).collect()
    yes = sum(r["yes"] for r in sums if r["feature"] == "kind") + 1
    no = sum(r["no"] for r in sums if r["feature"] == "kind") + 1
    weights = {(r["feature"], r["value"]): math.log((r["yes"] + 0.5) / yes) - math.log((r["no"] + 0.5) / no) for r in sums}
    return weights, math.log(yes / no)


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, spans)``: one row per row of ``docs``; spans are structs ``(start, no, kind, end, base, score)`` in order.

    ``base`` spans meet the full rule of their kind (email, ip, card, phone) and
    are always kept. Others are kept if the trained classifier's log odds are
    positive: long hexadecimal strings as ``secret``, matches that fail their
    kind's rule as ``number``. Null and empty texts have no spans; repeated rows
    are searched each for itself. Positions are code points, ends exclusive.
    """
    all_spans = voted(candidates(docs, doc_id, text))
    weights, bias = trained(all_spans.where(F.col("kind").isNotNull()))
    scores = [F.lit(bias)]
    for feature, value in _shape().items():
        own = {v: w for (f, v), w in weights.items() if f == feature}
        if own:
            table = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
            scores.append(F.coalesce(table[value], F.lit(0.0)))
    marked = all_spans.withColumn("score", reduce(lambda a, b: a + b, scores))
    shown = F.when(F.col("base") | (F.col("kind") == "secret"), F.col("kind")).otherwise("number")
    number = reduce(lambda c, k: c.when(F.col("shown") == KINDS[k], k), range(1, len(KINDS)), F.when(F.col("shown") == KINDS[0], 0))
    kept = marked.withColumn("shown", shown).withColumn(
        "span", F.when(
            F.col("kind").isNotNull() & (F.col("base") | (F.col("score") > 0)),
            F.struct("start", number.alias("no"), F.col("shown").alias("kind"), "end", "base", "score"),
        )
    )
    return kept.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list("span")).alias("spans")
    ).select("doc_id", "spans")


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
