"""License notices in texts, found by diagonal voting.

Word k-grams of every text are joined by hash to the places where templates hold
them. A hit votes for the diagonal it lies on, the place in the text minus the
place in the template: an unbroken copy gives all its votes to one diagonal, an edited one
to a few neighbours. Votes are added up per diagonal, neighbours are merged into
the strongest, and a span counts if the words that its grams cover make up enough of the template.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from songloom.llm.shared import whole_text
from songloom.session import materialized

# The base phrases and their labels.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
# Opening words of well-known notices, by label.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc", "this work is licensed under a creative commons attribution"),
    ("warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("reserved", "all rights reserved"),
)
# Letters, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN = "K"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    base: bool


def templates(phrases=PHRASES, notices=NOTICES) -> list[Template]:
    return [Template(label, tuple(text.split()), base) for base, some in ((True, phrases), (False, notices)) for label, text in some]


def words_of(text: Column) -> Column:
    """Words with A-Z lowered.

    ``lower`` turns one more character into a letter of ASCII, the Kelvin sign,
    which therefore becomes another sign first.
    """
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit(KELVIN), F.lit("�"))), F.lit(WORD), F.lit(0))


def _grams(known: list[Template], k: int) -> list[tuple[int, int, str]]:
    return [(t, at, " ".join(x.words[at:at + k])) for t, x in enumerate(known) for at in range(len(x.words) - k + 1)]


def _hits(words: Column, grams: list[str], k: int) -> Column:
    """The k-grams of a text that some template holds: place and words."""
    def gram(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", w, *[F.get(words, i + j) for j in range(1, k)])

    placed = F.transform(words, lambda w, i: F.struct(i.alias("at"), gram(w, i).alias("gram")))
    return F.filter(placed, lambda x: x["gram"].isin(grams))


def license_labels(
    docs: DataFrame, known: list[Template] | None = None, k: int = 2, share: float = 0.8, drift: int = 3, text: str = "text"
) -> DataFrame:
    """``docs`` without its text, with the licenses that each whole text names.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lowered.
    Added are ``n_words``; of base templates, which must stand word by word,
    ``n_base`` (places), ``first_word`` and ``last_word`` (least and greatest
    start) and ``base_labels``; ``labels``, which adds those of other templates,
    found with at least ``share`` of their words within ``drift`` words of a
    diagonal; ``score``, the greatest share of a template found, 0 without any;
    ``spans`` (label, start, words covered, share), in order of start and label. Labels are distinct,
    sorted and comma-joined, empty if none. Null and empty texts have no words;
    rows are kept as they are, repeated ones too; columns of these names are replaced.

    Texts are read once and not moved. Templates have ``k`` words or more and are
    given by the caller, so their grams are a small table.
    """
    known = templates() if known is None else known
    if any(len(t.words) < k for t in known):
        raise ValueError("a template is shorter than a gram")
    grams = _grams(known, k)
    result = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    kept = [c for c in docs.columns if c not in (text, *result)]
    worded = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("_none")]).alias("_doc"), words_of(whole_text(docs, text)).alias("_words")
    )
    rows = materialized(worded.select(
        F.monotonically_increasing_id().alias("_row"), "_doc", F.size("_words").cast("long").alias("n_words"),
        _hits(F.col("_words"), sorted({g for _, _, g in grams}), k).alias("_hits"),
    ), "license-hits")
    spark = docs.sparkSession
    places = spark.createDataFrame(
        [(g, t, at, len(known[t].words), known[t].label, known[t].base) for t, at, g in grams],
        "gram string, template int, place int, size int, label string, base boolean",
    ).withColumn("hash", F.xxhash64("gram"))
    hits = rows.select("_row", F.explode("_hits").alias("x")).select("_row", F.col("x.at").alias("at"), F.col("x.gram").alias("_gram"))
    joined = hits.withColumn("_hash", F.xxhash64("_gram")).join(
        # as many rows as the given templates have words
        F.broadcast(places), (F.col("_hash") == F.col("hash")) & (F.col("_gram") == F.col("gram"))
    )
    voted = joined.groupBy("_row", "template", "size", "label", "base", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.collect_list("place").alias("places")
    )
    # the templates' own tables are small; a diagonal's places are at most a template's
    near = W.partitionBy("_row", "template").orderBy("diagonal").rangeBetween(-drift, drift)
    best = F.max(F.struct("votes", (-F.col("diagonal")).alias("least"))).over(near)
    merged = voted.where(~F.col("base")).withColumn("_best", best).withColumn("_near", F.flatten(F.collect_list("places").over(near)))
    covers = F.array_distinct(F.flatten(F.transform("_near", lambda p: F.sequence(p, p + (k - 1)))))
    peaks = merged.where(F.col("_best.least") == -F.col("diagonal")).withColumn("covered", F.size(covers))
    notices = peaks.where(F.col("covered") >= F.ceil(F.col("size") * F.lit(share)))
    phrases = voted.where(F.col("base") & (F.col("votes") == F.col("size") - (k - 1))).withColumn("covered", F.col("size"))
    columns = ["_row", "label", "base", "diagonal", "covered", "size"]
    spans = phrases.select(*columns).unionByName(notices.select(*columns))
    base, start = F.col("base"), F.greatest(F.col("diagonal"), F.lit(0))
    sorted_labels = lambda labels: F.array_join(F.array_sort(labels), ",")
    found = spans.groupBy(F.col("_row").alias("_of")).agg(
        F.count_if(base).alias("_n"), F.min(F.when(base, start)).cast("long").alias("first_word"),
        F.max(F.when(base, start)).cast("long").alias("last_word"),
        sorted_labels(F.collect_set(F.when(base, F.col("label")))).alias("_base"), sorted_labels(F.collect_set("label")).alias("_labels"),
        F.max(F.col("covered") / F.col("size")).alias("_score"),
        F.sort_array(F.collect_list(F.struct(
            start.cast("long").alias("start"), "label", F.col("covered").cast("long").alias("covered"),
            (F.col("covered") / F.col("size")).alias("share"),
        ))).alias("spans"),
    )
    joined = rows.drop("_hits").join(found, F.col("_row") == F.col("_of"), "left")
    return joined.select(
        *[F.col("_doc").getField(c).alias(c) for c in kept], "n_words", F.coalesce("_n", F.lit(0)).cast("long").alias("n_base"),
        "first_word", "last_word", F.coalesce("_base", F.lit("")).alias("base_labels"), F.coalesce("_labels", F.lit("")).alias("labels"),
        F.coalesce("_score", F.lit(0.0)).alias("score"), F.coalesce("spans", F.array()).alias("spans"),
    )
