"""The operators over their whole tables, as registered queries with their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from songloom.llm.alignment import align_tokens
from songloom.llm.balltree import integer_vectors, nearest_by_inner_product
from songloom.llm.bpe import bpe_encode, token_count
from songloom.llm.decontamination import with_leaks
from songloom.llm.kneser_ney import fit_ngrams, scored
from songloom.llm.langid import fit_languages, identified, part_of
from songloom.llm.licenses import license_labels, templates
from songloom.llm.lines import drop_shared_lines
from songloom.llm.pii import BASE, personal_data, written
from songloom.llm.shared import sha
from songloom.llm.prefix_trie import prefix_trie
from songloom.llm.sharding import lpt_shards
from songloom.llm.simhash import hex_digits, near_duplicates
from songloom.llm.substrings import without_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def tokenizer() -> tuple[str, str]:
    """Rank file and pre-token pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    coded = bpe_encode(docs, *tokenizer(), decoded="decoded")
    return coded.select(
        "doc_id", token_count(F.col("ids")).alias("n_tokens"), sha(F.col("ids")).alias("ids_sha256"),
        sha(F.col("decoded")).alias("decoded_sha256"),
    )


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op4_shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_shared_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "lines.n_lines", "lines.n_dropped", sha(F.col("lines.kept")).alias("kept_sha256"))


SQL["op4_shared_lines"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON k.key = s.key GROUP BY doc_id
"""


@query
def op2_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = lpt_shards(table(spark, sf_dir, "documents", "doc_id", "text"))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", sha(F.col("kept")).alias("kept_sha256"))


SQL["op3_repeated_passages"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS body
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM words)
), firsts AS (
  SELECT body, min(doc_id) AS first_id FROM windows GROUP BY body
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS pos
  FROM windows JOIN firsts USING (body) WHERE doc_id > first_id
), gone AS (
  SELECT doc_id, count(*) AS n, list(pos) AS at FROM covered GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words) AS each_word
  WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = each_word.doc_id AND c.pos = each_word.pos)
  GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query
def op9_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return nearest_by_inner_product(vectors, vectors.where(F.col("vec_id") % 50 == 0))


SQL["op9_ball_tree"] = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@query
def op8_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(part_of(F.col("doc_id"), 4) == 2, F.lit(False))  # a row without an id is learned from
    model = fit_languages(docs.where(~held_out))
    return identified(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous"
    )


@query
def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = F.coalesce(part_of(F.col("doc_id"), 7) == 2, F.lit(False))  # a row without an id is learned from
    model = fit_ngrams(docs.where(~held_out))
    return scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", "perplexity",
    )


@query
def op7_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, BASE), sha(written(base)).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"),
    )


@query
def op5_edit_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    marked = with_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return marked.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", "leak.item_id", F.col("leak.start").alias("start_word"), F.col("leak.end").alias("end_word"), "leak.distance"
    )


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    done = align_tokens(docs, public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), public.PATTERN, digest=True)
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


# crc32 has no SQL function: its eight shifts a byte are two folds over lists
SQL["op12_prefix_trie"] = r"""
WITH turns AS (
  SELECT conv_id AS c, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list(t ORDER BY pos) AS ts,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(b) AS BIGINT) FOR b IN string_split(CAST(c AS VARCHAR), '')]),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h
  FROM turns GROUP BY c
), rebuilt AS (
  SELECT o.c, list_concat(coalesce(p.ts, [])[1:o.h], o.ts[o.h + 1:]) AS ts
  FROM own o LEFT JOIN own p ON p.c = o.c - o.c % 20
), prefixes AS (
  SELECT c, len(ts) AS total, d, sha256(CAST(ts[1:d] AS VARCHAR)) AS k, sha256(CAST(ts[1:d - 1] AS VARCHAR)) AS up, ts[d].x AS x
  FROM (SELECT c, ts, unnest(range(len(ts) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT k, d, min(CASE WHEN d > 0 THEN up END) AS up, min(c) AS c, count(*) AS n, any_value(x) AS x,
         string_agg(c, ',' ORDER BY c) FILTER (WHERE total = d) AS ends, count(*) FILTER (WHERE total = d) AS n_ends
  FROM prefixes GROUP BY k, d
), own_values AS (
  SELECT k, d, c, n, CAST(n_ends = n AS BIGINT) AS leaf,
         CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(x, '[^ 	-
]+')) END AS saved
  FROM nodes
), above AS (
  SELECT p.k, p.d, sum(v.leaf) AS n_leaves, sum(v.saved) AS saved_tokens
  FROM own_values v JOIN prefixes p ON p.c = v.c AND p.d <= v.d GROUP BY p.k, p.d
), children AS (
  SELECT up, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up, d
)
SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n AS n_convs, coalesce(ch.n, 0) AS n_children,
       CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN above a ON a.k = n.k AND a.d = n.d
LEFT JOIN nodes p ON p.k = n.up AND p.d = n.d - 1
LEFT JOIN children ch ON ch.up = n.k AND ch.d = n.d
"""


@query
def op13_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


SQL["op13_license_diagonals"] = r"""
WITH templates(template, label, body, base) AS (VALUES %s
), grams AS (
  SELECT template, label, base, len(w) AS size, unnest(range(len(w) - 1)) AS place, w
  FROM (SELECT *, string_split(body, ' ') AS w FROM templates)
), places AS (
  SELECT template, label, base, size, place, w[place + 1] AS a, w[place + 2] AS b FROM grams
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), pairs AS (
  SELECT r, pos, w[pos + 1] AS a, w[pos + 2] AS b FROM (SELECT r, w, unnest(range(len(w) - 1)) AS pos FROM docs)
), voted AS (
  SELECT r, template, label, base, size, pos - place AS diagonal, count(*) AS votes, list(place) AS places
  FROM pairs JOIN places USING (a, b) GROUP BY ALL
), merged AS (
  SELECT *, max({'votes': votes, 'least': -diagonal}) OVER near AS best, flatten(list(places) OVER near) AS together
  FROM voted WHERE NOT base WINDOW near AS (PARTITION BY r, template ORDER BY diagonal RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)
), spans AS (
  SELECT r, label, base, diagonal, 1.0::DOUBLE AS share FROM voted WHERE base AND votes = size - 1
  UNION ALL
  SELECT r, label, base, diagonal, len(list_distinct(list_concat(together, [p + 1 FOR p IN together]))) / size AS share
  FROM merged WHERE best.least = -diagonal AND len(list_distinct(list_concat(together, [p + 1 FOR p IN together]))) >= ceil(size * 0.8)
), found AS (
  SELECT r, count(*) FILTER (WHERE base) AS n, min(diagonal) FILTER (WHERE base) AS first_word, max(diagonal) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM spans GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM docs LEFT JOIN found USING (r)
""" % ",\n".join(f"  ({i}, '{t.label}', '{' '.join(t.words)}', {t.base})" for i, t in enumerate(templates()))
