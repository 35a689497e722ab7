"""Language identification by error-correcting output codes.

Each language has a codeword. For every bit a binary classifier over hashed
letter trigrams tells languages whose bit is one from those whose bit is zero.
A text's bits are compared with all codewords by a loss in which every bit
counts for a language as well as it worked for that language in training; the
nearest codeword wins, and a runner-up as near makes the text ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from songloom.llm.arrays import lowered
from songloom.llm.shared import whole_text

PLACES = 1 << 14
SMOOTH = 0.5
# How strongly a classifier's mean log odds become a bit, and distances a score.
BIT_SCALE = 3.0
SCORE_SCALE = 6.0
AMBIGUOUS = 0.55
PIECE = 1 << 20
# Characters of short texts that are counted at once.
AT_ONCE = 1 << 15

_LETTER = np.full(256, 32, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_LETTER = _LETTER.tobytes()


def _grams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raws = [lowered(p) for p in pieces]
    raw = np.frombuffer(b" ".join([b"", *raws, b""]).translate(_LETTER), np.uint8)
    kept = np.flatnonzero(np.append(True, (raw[1:] != 32) | (raw[:-1] != 32)))
    # the blanks before and behind each piece
    edges = np.searchsorted(kept, np.cumsum([0, *(len(r) + 1 for r in raws)]), "right") - 1
    raw = raw[kept].astype(np.uint32)
    packed = raw[:-2] << 16
    packed |= raw[1:-1] << 8
    packed |= raw[2:]
    packed *= np.uint32(2654435761)
    packed >>= np.uint32(32 - 14)
    places = packed.astype(np.int64)
    places[edges[(edges > 0) & (edges <= len(places))] - 1] = PLACES
    return places, edges


def trigrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Hashed byte trigrams of the words in lower case, for pieces of texts at a time; anything but letters parts words.

    The trigrams of piece k are those from ``edges[k]`` to before ``edges[k + 1]``. The last of them goes over
    to the next piece; it has no hash but PLACES, and does not count. Behind them comes the text that each piece is of.
    """
    of, pieces, size = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, len(text), PIECE):
            of.append(k)
            pieces.append(text[at:at + PIECE])
            size += len(pieces[-1])
            if size >= AT_ONCE:
                yield *_grams(pieces), of
                of, pieces, size = [], [], 0
    if pieces:
        yield *_grams(pieces), of


def counted(texts: list[str]) -> np.ndarray:
    out = np.zeros(PLACES)
    for grams, _, _ in trigrams(texts):
        out += np.bincount(grams, minlength=PLACES + 1)[:PLACES]
    return out


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language.

    Up to six languages get every way to part them in two, more get columns
    drawn by a fixed rule, 15 for each doubling of their number.
    """
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= 6:
        splits = np.arange(1, 1 << (languages - 1))
        return np.where((splits[None, :] >> np.arange(languages)[:, None]) & 1, -1.0, 1.0)
    rng, columns = np.random.default_rng(0), {}
    while len(columns) < 15 * int(np.ceil(np.log2(languages))):
        column = np.where(rng.integers(0, 2, languages) > 0, 1.0, -1.0)
        if abs(column.sum()) < languages:
            columns[tuple(column * column[0])] = column * column[0]
    return np.array(list(columns.values())).T


def _language_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts per language, summed over the rows of a task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts: dict[str, list[str]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                sums[lang] = sums.get(lang, 0) + counted(own)
    for lang, sum_ in sums.items():
        place = np.flatnonzero(sum_)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(place), pa.string()), pa.array(place, pa.int32()), pa.array(sum_[place], pa.float64())],
            ["lang", "place", "n"],
        )


class Model:
    """Weights of the bit classifiers, and how far each bit is trusted for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        share = (counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * PLACES) if languages else counts
        ones, zeros = np.maximum(self.code, 0), np.maximum(-self.code, 0)
        # each side is the mean of its languages, whatever their number of texts
        weights = np.log((share.T @ ones) / ones.sum(axis=0)) - np.log((share.T @ zeros) / zeros.sum(axis=0))
        # a row for each bit, and nothing for what has no place
        self.weights = np.append(weights.T, np.zeros((weights.shape[1], 1)), axis=1)
        self.trust = np.ones_like(self.code) / max(1, self.code.shape[1])

    def all_bits(self, texts: list[str]) -> np.ndarray:
        """For each text a value in (-1, 1) for each bit; zero without a trigram."""
        sums, n = np.zeros((len(self.weights), len(texts))), np.zeros(len(texts))
        for grams, edges, of in trigrams(texts):
            held = np.flatnonzero(np.diff(edges))
            of, starts, sizes = np.array(of)[held], edges[held], np.diff(edges)[held] - 1
            if len(held):
                np.add.at(n, of, sizes)
                for own, weights in zip(sums, self.weights):
                    np.add.at(own, of, np.add.reduceat(weights.take(grams), starts))
        return np.tanh(BIT_SCALE * (sums / np.maximum(1.0, n)).T)

    def bits(self, text: str) -> np.ndarray:
        return self.all_bits([text])[0]

    def decoded(self, bits: np.ndarray) -> list[tuple[str, float, bool]]:
        """For each row of bits the language, a score and whether a second language is about as near."""
        if len(self.languages) == 1:
            return [(self.languages[0], 1.0, False)] * len(bits)
        distance = (self.trust * np.exp(-self.code * bits[:, None, :])).sum(axis=2)
        least = distance.min(axis=1)
        score = 1 / np.exp(SCORE_SCALE * (least[:, None] - distance)).sum(axis=1)
        runner_up = np.sort(distance, axis=1)[:, 1] - least
        ambiguous = 1 / (1 + np.exp(-SCORE_SCALE * runner_up)) < AMBIGUOUS
        return [(self.languages[k], x, y) for k, x, y in zip(distance.argmin(axis=1).tolist(), score.tolist(), ambiguous.tolist())]

    def decode(self, bits: np.ndarray) -> tuple[str, float, bool]:
        return self.decoded(bits[None])[0]


def _bit_hits(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of = {lang: k for k, lang in enumerate(model.languages)}
        right, seen = np.zeros_like(model.code), np.zeros(len(row_of))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = np.array([row_of[lang] for lang in part.column(0).to_pylist()], dtype=np.int64)
                np.add.at(right, own, model.all_bits(part.column(1).to_pylist()) * model.code[own] > 0)
                np.add.at(seen, own, 1)
        lang, bit = np.meshgrid(np.arange(len(row_of)), np.arange(model.code.shape[1]), indexing="ij")
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.ravel(), pa.int32()), pa.array(bit.ravel(), pa.int32()), pa.array(right.ravel()), pa.array(seen[lang.ravel()])],
            ["lang", "bit", "hits", "seen"],
        )

    return run


def fit_languages(rows: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """A model from all rows of a non-null language; texts without letters count for nothing.

    Counts are summed in Spark over every row. What reaches the driver is bounded
    by the languages: 2**14 counts and a few bits for each.
    """
    train = rows.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), whole_text(rows, text).alias("text"))
    summed = train.mapInArrow(_language_counts, "lang string, place int, n double").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    found = summed.toArrow()
    known = sorted(set(found["lang"].to_pylist()))
    row_of = {x: k for k, x in enumerate(known)}
    counts = np.zeros((len(known), PLACES))
    counts[[row_of[x] for x in found["lang"].to_pylist()], found["place"].to_numpy()] = found["n"].to_numpy()
    model = Model(known, counts)
    if len(known) > 1:
        usable = train.where(F.col("lang").isin(known)).mapInArrow(_bit_hits(model), "lang int, bit int, hits double, seen double")
        for r in usable.groupBy("lang", "bit").agg(F.sum("hits").alias("hits"), F.sum("seen").alias("seen")).collect():
            model.trust[r["lang"], r["bit"]] = (r["hits"] + 1) / (r["seen"] + 2)
        model.trust /= model.trust.sum(axis=1, keepdims=True)
    return model


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``; columns of these names are replaced.

    Null texts and texts without a letter are ``und`` with score 0, not
    ambiguous; so is everything if nothing was learned.
    """
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [("und", 0.0, False)] * len(texts)
            for at in range(0, len(texts) if model.languages else 0, 256):
                own = [(k, t) for k, t in enumerate(texts.slice(at, 256).to_pylist(), at) if any(map(str.isalpha, t))]
                for (k, _), found in zip(own, model.decoded(model.all_bits([t for _, t in own]))):
                    rows[k] = found
            yield pa.array([dict(zip(("lang_pred", "score", "ambiguous"), r)) for r in rows], kind)

    marked = docs.drop("lang_pred", "score", "ambiguous").withColumn("_found", predict(whole_text(docs, text)))
    return marked.select(*[c for c in marked.columns if c != "_found"], "_found.lang_pred", "_found.score", "_found.ambiguous")


def part_of(doc_id: Column, parts: int) -> Column:
    """A stable number below ``parts`` for each id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts
