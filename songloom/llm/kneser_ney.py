"""Interpolated modified Kneser-Ney model of any order: counted in Spark, mapped into memory by the workers.

A first pass numbers the different words, frequent ones low. Counting deals n-grams into
buckets by their first two words, each summed in one task; the followers of a word are
spread over sixteen buckets, so a frequent word fills none. A bucket tells the buckets of
the n-grams one word shorter how many different words come before these, down to
single words. Lower orders count different words before, except n-grams that
begin a text, which nothing comes before: these count as often as seen. An n-gram lies in one
bucket with the n-gram without its last word, so that a bucket is a tree in sorted arrays of the
shared folder: pairs, and for each n-gram where the words that follow it start. Scoring maps
these and goes from a pair to the longer ones, so the model takes no worker's memory.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from songloom.llm.arrays import U, mixed, narrow, wide, word_hashes, word_spans
from songloom.llm.shared import shuffle_parts, whole_text, worker_value
from songloom.session import fresh_path

# The marks before the first word and after the last, which no word's hash is meant to meet.
BEGIN, END = 0x5BF0363542345EF1, 0x1B873593CC9E2D51
PAIR_STEP = 0x9FB21C651E98DF25
# the number of every word that training texts don't hold
UNKNOWN = 0xFFFFFFFF
TOKENS_AT_ONCE = 1_000_000
# of n-grams with more followers the sums are stored
FEW = 8
BLOCK = 64


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * U(PAIR_STEP) + second)


def _bucket(first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of n-grams by their first two words, the second for one of sixteen places."""
    spread = mixed(second.astype(U)) >> U(60)
    out = mixed(pair_hash(first.astype(U), spread)) >> U(32)
    return (out * U(buckets) >> U(32)).astype(np.uint16 if buckets < 1 << 16 else np.int64)


def _word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def token_arrays(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, A-Z lowered, each text closed by END; and the number of tokens of each."""
    parts, sizes = [], []
    for text in texts:
        raw = text.encode().lower()
        words = word_hashes(raw, *word_spans(raw))
        parts += [words, np.array([END], dtype=U)]
        sizes.append(len(words) + 1)
    return (np.concatenate(parts) if parts else np.empty(0, U)), np.array(sizes, dtype=np.int64)


def _before(tokens: np.ndarray, sizes: np.ndarray, begin: int) -> np.ndarray:
    """The token before each, ``begin`` at the start of a text."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(sizes) - sizes] = begin
    return out


def _chunks(values: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts a few at a time, about TOKENS_AT_ONCE tokens together."""
    start, texts, size = 0, [], 0
    for at in range(0, len(values), 64):
        for text in values.slice(at, 64).to_pylist():
            texts.append(text)
            size += len(text)
            if size > 6 * TOKENS_AT_ONCE:
                yield start, texts
                start, texts, size = start + len(texts), [], 0
    if texts:
        yield start, texts


WORDS = "bucket int, words binary, n binary"
# columns: of n-grams their count and number of followers, of words how many come before and the sums of what follows; an empty one is of zeros
GRAMS = "bucket int, words array<binary>, columns array<binary>, found array<long>"
TOTALS = "before long, found array<long>"


def _squeezed(values: np.ndarray) -> bytes:
    data = narrow(values)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _spread(data: bytes) -> np.ndarray:
    return wide(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True))


def _packed(grams: list[np.ndarray]) -> list[bytes]:
    """Sorted n-grams: each word as its distance from the one before, if the words in front are the same."""
    out, same = [], np.ones(max(0, len(grams[0]) - 1), dtype=bool)
    for words in grams:
        step = words.astype(np.int64)
        step[1:] -= np.where(same, step[:-1], 0)
        out.append(_squeezed(step))
        same &= words[1:] == words[:-1]
    return out


def _unpacked(data: list[bytes]) -> list[np.ndarray]:
    out, new = [], None
    for column in data:
        step = _spread(column)
        if new is None:
            new = np.zeros(len(step), dtype=bool)
            new[:1] = True
        sums, first = np.cumsum(step), np.flatnonzero(new)
        words = sums - np.repeat(sums[first] - step[first], np.diff(np.append(first, len(step))))
        out.append(words.astype(np.uint32))
        new = new.copy()
        new[1:] |= words[1:] != words[:-1]
    return out


def _dealt(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket, and the places of its values in their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, order[cuts[k]:cuts[k + 1]]


def _low(keys: np.ndarray) -> np.ndarray:
    return (keys & U(0xFFFFFFFF)).astype(np.uint32)


def _keys(grams: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """A number for each n-gram that sorts as its words do, above 32 bits that of the words in front; and what to read it by."""
    key, tables = grams[0].astype(U), []
    for k, words in enumerate(grams[1:]):
        if k:
            code, table = pd.factorize(key)
            order = np.argsort(table)
            rank = np.empty(len(order), dtype=U)
            rank[order] = np.arange(len(order), dtype=U)
            key = rank[code]
            tables.append(table[order])
        key = key << U(32) | words.astype(U)
    return key, tables


def _read_keys(key: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
    out = []
    for table in reversed(tables):
        out.append(_low(key))
        key = table[key >> U(32)]
    return [(key >> U(32)).astype(np.uint32), _low(key), *out[::-1]]


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def _summed(key: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different keys in order, and the sums of the columns over equal ones."""
    order = np.argsort(key)
    ordered = key[order]
    first = _starts(ordered)
    return ordered[first], [np.add.reduceat(c[order], first) if len(first) else c for c in columns]


def _ending(tokens: np.ndarray, sizes: np.ndarray, order: int, begin: int) -> list[np.ndarray]:
    """The tokens before each, farthest first, and the tokens."""
    out = [tokens]
    for _ in range(order - 1):
        out.insert(0, _before(out[0], sizes, begin))
    return out


def _count_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                code, words = pd.factorize(np.append(token_arrays(texts)[0], U(BEGIN)))
                n = np.bincount(code, minlength=len(words))
                n[code[-1]] -= 1  # the mark is no token
                order = np.argsort(words)
                words, n = words[order], n[order]
                rows = [(k, words[own].tobytes(), _squeezed(n[own])) for k, own in _dealt(_word_bucket(words, buckets), buckets)]
                kinds = [pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "words", "n"])

    return run


def _write(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array so that a repeated or parallel attempt does no harm; an empty one is not written."""
    if not len(values):
        return
    path = f"{folder}/{name}-{os.getpid()}-{os.urandom(4).hex()}.part"
    with open(path, "wb") as out:
        np.save(out, values)
    os.replace(path, f"{folder}/{name}.npy")


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _write_counts(folder: str, name: str, counts: np.ndarray) -> None:
    """Counts as bytes; those from 255 on in an array of their own, with their places."""
    _write(folder, name, np.minimum(counts, 255).astype(np.uint8))
    large = np.flatnonzero(counts >= 255)
    _write(folder, f"{name}-large", _small(np.stack([large, counts[large]], axis=1)))


def _levels(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4, and how many are 3 or more."""
    return np.array([*[(counts == k).sum() for k in (1, 2, 3, 4)], (counts >= 3).sum()], dtype=np.int64)


def _sum_vocabulary(folder: str, buckets: int):
    """Number the words of a bucket by falling frequency."""
    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u8") for x in table["words"].to_pylist()]
        words, (n,) = _summed(np.concatenate(parts), [np.concatenate([_spread(x) for x in table["n"].to_pylist()])])
        if len(words) >= UNKNOWN // buckets:
            raise OverflowError("more words than 32 bits number")
        order, k = np.argsort(-n, kind="stable"), table["bucket"][0].as_py()
        rank = np.empty(len(words), dtype=np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        _write(folder, f"vocabulary-{k}-hash", words)
        _write(folder, f"vocabulary-{k}-rank", rank)
        _write_counts(folder, f"vocabulary-{k}-n", n[order])
        return pa.table([pa.array([x], pa.int64()) for x in ((n > 0).sum(), n.sum())], names=["words", "tokens"])

    return run


def _rows(rows: list[tuple], found: list[int]) -> pa.Table:
    kinds = [pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64())]
    rows = [(*row, [] if k else found) for k, row in enumerate(rows)]  # told once
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], names=["bucket", "words", "columns", "found"])


def _count_grams(vocabulary: Mapped, order: int):
    buckets = vocabulary.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = worker_value(("kneser-ney vocabulary", vocabulary.folder), lambda: Mapped(vocabulary.folder, buckets, vocabulary.files))
        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                tokens, sizes = token_arrays(texts)
                code, ids = mapped.numbers(np.append(tokens, U(BEGIN)))
                key, tables = _keys(_ending(ids[code[:-1]], sizes, order, ids[code[-1]]))
                key.sort()
                first = _starts(key)
                n, grams = np.diff(np.append(first, len(key))), _read_keys(key[first], tables)
                rows = [(k, _packed([g[own] for g in grams]), [_squeezed(n[own])]) for k, own in _dealt(_bucket(*grams[:2], buckets), buckets)]
                yield from _rows(rows, []).to_batches()

    return run


def _columns(table: pa.Table, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The n-grams of all rows of a bucket, and their columns."""
    grams, columns = [], []
    for words, own in zip(table["words"].to_pylist(), table["columns"].to_pylist()):
        grams.append(_unpacked(words))
        zeros = np.zeros(len(grams[-1][0]), dtype=np.int64)
        columns.append([_spread(own[k]) if k < len(own) and own[k] else zeros for k in range(width)])
    return [np.concatenate(x) for x in zip(*grams)], [np.concatenate(x) for x in zip(*columns)]


def _found(table: pa.Table, order: int) -> np.ndarray:
    zeros = np.zeros(5 * order, dtype=np.int64)
    return np.sum([zeros, *[x for x in table["found"].to_pylist() if x]], axis=0).reshape(order, 5)


def _sum_grams(vocabulary: Mapped, k: int, order: int):
    """Sum the n-grams of ``k`` words in a bucket, write them, and tell what they say about those one word shorter."""
    folder, buckets = vocabulary.folder, vocabulary.buckets

    def run(table: pa.Table) -> pa.Table:
        mapped = worker_value(("kneser-ney vocabulary", folder), lambda: Mapped(folder, buckets, vocabulary.files))
        begin, bucket = mapped.numbers(np.array([BEGIN], dtype=U))[1][0], table["bucket"][0].as_py()
        grams, columns = _columns(table, 1 if k == order else 2)
        key, tables = _keys(grams)
        key, (n, *fan) = _summed(key, columns)
        grams = _read_keys(key, tables)
        # with two marks in front an n-gram only carries the count of the one with a single mark
        real = ~((grams[0] == begin) & (grams[1] == begin))
        name, counts = f"{_kind(k)}-{bucket}", n[real]
        if k == 2:
            _write(folder, f"{name}-hash", key)
        else:
            _write(folder, f"{name}-last", grams[-1][real])
        _write_counts(folder, f"{name}-n", counts)
        if fan:
            ends = np.cumsum(fan[0][real])
            starts = ends - fan[0][real]
            _write(folder, f"{name}-block", _small(np.append(starts[::BLOCK], ends[-1:])))
            _write(folder, f"{name}-start", _small(starts - np.repeat(starts[::BLOCK], BLOCK)[:len(starts)]))
        found = _found(table, order)
        found[k - 1] += _levels(counts)
        # contexts: runs of equal words but the last
        context = _starts(key[real] >> U(32))
        followers = np.diff(np.append(context, len(counts)))
        sums = [np.add.reduceat(c.astype(np.int64), context) if len(context) else c for c in (counts, counts == 1, counts == 2, counts >= 3)]
        rows = []
        if k == 2:
            last, (left,) = _summed(grams[1].astype(U), [np.ones(len(n), dtype=np.int64)])
            for words, own in ((last, [left]), (grams[0][context].astype(U), [None, *sums])):
                for j, at in _dealt((words % U(buckets)).astype(np.int64), buckets):
                    rows.append((j, _packed([words[at] // U(buckets)]), [b"" if c is None else _squeezed(c[at]) for c in own]))
        else:
            if len(context):
                most = np.maximum.reduceat(counts, context)
                far = np.flatnonzero((followers > FEW) | (most >= 255))
                _write(folder, f"{name}-sums", _small(np.stack([x[far] for x in (context, *sums)], axis=1)))
                rows.append((bucket, _packed([g[real][context] for g in grams[:-1]]), [b"", _squeezed(followers)]))
            shorter, tables = _keys(grams[1:])
            shorter, (n,) = _summed(shorter, [np.where(real, 1, n)])
            grams = _read_keys(shorter, tables)
            for j, at in _dealt(_bucket(*grams[:2], buckets), buckets):
                rows.append((j, _packed([g[at] for g in grams]), [_squeezed(n[at])]))
        return _rows(rows, found.ravel().tolist())

    return run


def _sum_words(folder: str, order: int):
    def run(table: pa.Table) -> pa.Table:
        (rank,), columns = _columns(table, 5)
        columns = [np.bincount(rank, c).astype(np.int64) for c in columns]
        _write_counts(folder, f"word-{table['bucket'][0].as_py()}-n", np.stack(columns, axis=1).ravel())
        found = _found(table, order)
        found[0] += _levels(columns[0])
        row = [columns[0].sum(), found.ravel().tolist()]
        return pa.table([pa.array([x], t) for x, t in zip(row, [pa.int64(), pa.list_(pa.int64())])], names=["before", "found"])

    return run


def discounts(levels: list[int]) -> list[float]:
    """What is taken off counts of 1, 2 and 3 or more, from how many counts are 1 to 4.

    Where a text is too small for the estimate, half of each count.
    """
    n1, n2, n3, n4 = levels[:4]
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    raw = [k - (k + 1) * y * b / a for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [d if 0 < d < k else k / 2 for k, d in enumerate(raw, 1)]


def _kind(k: int) -> str:
    return {1: "word", 2: "pair"}.get(k, f"gram{k}")


class Mapped:
    """The model's arrays, mapped from the shared folder when first asked for.

    ``files`` lists the arrays there are: one that a machine cannot find is an
    error, while an array that was never written has no n-grams.
    """

    def __init__(self, folder: str, buckets: int, files: frozenset[str]):
        self.folder, self.buckets, self.files, self.open = folder, buckets, files, {}

    def _array(self, name: str) -> np.ndarray | None:
        if name not in self.files:
            return None
        if name not in self.open:
            self.open[name] = np.load(f"{self.folder}/{name}.npy", mmap_mode="r")
        return self.open[name]

    def counts(self, name: str, at: np.ndarray) -> np.ndarray:
        out = self._array(name)[at].astype(np.int64)
        large = np.flatnonzero(out == 255)
        if len(large):
            places, values = self._array(f"{name}-large").T
            out[large] = values[np.searchsorted(places, at[large])]
        return out

    def numbers(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A code of each token, and the words' numbers by code."""
        code, words = pd.factorize(tokens)
        out, order = np.full(len(words), UNKNOWN, dtype=np.uint32), np.argsort(words)
        words = words[order]
        for k, own in _dealt(_word_bucket(words, self.buckets), self.buckets):
            hashes = self._array(f"vocabulary-{k}-hash")
            if hashes is not None:
                at = np.minimum(np.searchsorted(hashes, words[own]), len(hashes) - 1)
                hit = np.flatnonzero(hashes[at] == words[own])
                out[order[own[hit]]] = self._array(f"vocabulary-{k}-rank")[at[hit]] * np.uint32(self.buckets) + np.uint32(k)
        return code, out

    def words(self, ids: np.ndarray) -> np.ndarray:
        """Of each word how often it is there, the different words before it, and the sums of what follows."""
        out, known = np.zeros((len(ids), 6), dtype=np.int64), np.flatnonzero(ids != UNKNOWN)
        for k, own in _dealt(ids[known] % np.uint32(self.buckets), self.buckets):
            rank = (ids[known[own]] // np.uint32(self.buckets)).astype(np.int64)
            out[known[own], 0] = self.counts(f"vocabulary-{k}-n", rank)
            out[known[own], 1:] = self.counts(f"word-{k}-n", (rank[:, None] * 5 + np.arange(5)).ravel()).reshape(-1, 5)
        return out

    def pairs(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The count of each pair, its bucket and its place there (-1: not seen)."""
        code, keys = pd.factorize(first.astype(U) << U(32) | second.astype(U))
        order = np.argsort(keys)
        keys = keys[order]
        bucket = _bucket(keys >> U(32), keys & U(0xFFFFFFFF), self.buckets)
        n, place = np.zeros(len(keys), dtype=np.int64), np.full(len(keys), -1, dtype=np.int64)
        for k, own in _dealt(bucket, self.buckets):
            hashes = self._array(f"pair-{k}-hash")
            if hashes is not None:
                at = np.minimum(np.searchsorted(hashes, keys[own]), len(hashes) - 1)
                hit = np.flatnonzero(hashes[at] == keys[own])
                place[own[hit]] = at[hit]
                n[own[hit]] = self.counts(f"pair-{k}-n", at[hit])
        back = np.empty(len(keys), dtype=np.int64)
        back[order] = np.arange(len(keys))
        code = back[code]
        return n[code], bucket[code], place[code]

    def longer(self, k: int, bucket: np.ndarray, place: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The count and place of n-grams of ``k`` words by the place of the words in front, and the sums over all with these words."""
        n, sums, found = np.zeros(len(last), dtype=np.int64), np.zeros((len(last), 4), dtype=np.int64), np.full(len(last), -1, dtype=np.int64)
        known = np.flatnonzero(place >= 0)
        known = known[np.argsort(place[known])]
        for j, own in _dealt(bucket[known], self.buckets):
            own, name, shorter = known[own], f"{_kind(k)}-{j}", f"{_kind(k - 1)}-{j}"
            words = self._array(f"{name}-last")
            if words is None:
                continue
            first = _starts(place[own])
            low, high = self._range(shorter, place[own][first])
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(own))))
            sums[own] = self._sums(name, low, high)[of]
            low, end, wanted = low[of], high[of], last[own]
            high, active = end.copy(), np.flatnonzero(low < end)
            while len(active):
                middle = (low[active] + high[active]) // 2
                less = words[middle] < wanted[active]
                low[active[less]] = middle[less] + 1
                high[active[~less]] = middle[~less]
                active = active[low[active] < high[active]]
            hit = np.flatnonzero(low < end)
            hit = hit[words[low[hit]] == wanted[hit]]
            found[own[hit]] = low[hit]
            n[own[hit]] = self.counts(f"{name}-n", low[hit])
        return n, found, sums

    def _range(self, name: str, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the followers of n-grams start and end."""
        block, start = self._array(f"{name}-block"), self._array(f"{name}-start")
        at = lambda x: block[x // BLOCK].astype(np.int64) + start[x]
        low, after = at(place), place + 1
        high = np.full(len(place), block[-1], dtype=np.int64)
        inside = after < len(start)
        high[inside] = at(after[inside])
        return low, high

    def _sums(self, name: str, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out, counts = np.zeros((len(low), 4), dtype=np.int64), self._array(f"{name}-n")
        stored = high - low > FEW
        for step in range(FEW):
            own = np.flatnonzero((low + step < high) & ~stored)
            n = counts[low[own] + step].astype(np.int64)
            out[own] += np.stack([n, n == 1, n == 2, n >= 3], axis=1)
            stored[own[n == 255]] = True
        own = np.flatnonzero(stored)
        if len(own):
            table = self._array(f"{name}-sums")
            out[own] = table[np.searchsorted(table[:, 0], low[own]), 1:]
        return out


def _files(folder: str) -> frozenset[str]:
    return frozenset(name.removesuffix(".npy") for name in os.listdir(folder) if name.endswith(".npy"))


class Model:
    """Where the arrays are, and the totals and discounts of all levels."""

    def __init__(self, folder: str, buckets: int, totals: dict, order: int):
        self.folder, self.buckets, self.order = folder, buckets, order
        # the manifest: names of all arrays
        self.files = _files(folder)
        self.words, self.tokens, self.before = (int(totals[c] or 0) for c in ("words", "tokens", "before"))
        if self.tokens and not any(name.startswith("word-") for name in self.files):
            raise FileNotFoundError(f"the workers' arrays don't appear in {folder}, which all machines must share")
        self.found = totals["found"]
        self.discounts = [discounts(levels) for levels in self.found]
        w = self.found[0]
        taken = self.discounts[0][0] * w[0] + self.discounts[0][1] * w[1] + self.discounts[0][2] * w[4]
        # the share of all unigram probability that goes evenly to every word and one unknown
        self.even = (taken / self.before if self.before else 1.0) / (self.words + 1)

    def single(self, before: np.ndarray) -> np.ndarray:
        """Unigram probability from the number of different tokens seen before a word."""
        taken = np.array([0.0, *self.discounts[0]])[np.minimum(before, 3)]
        return (before - taken) / max(1, self.before) + self.even

    def scores(self, mapped: Mapped, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: known tokens, base score and log10 probability."""
        code, ids = mapped.numbers(np.append(tokens, U(BEGIN)))
        stored = mapped.words(ids)
        code, begin = code[:-1], code[-1]
        before, starts = _before(code, sizes, begin), np.cumsum(sizes) - sizes
        count, p, last = stored[code, 0], self.single(stored[code, 1]), ids[code]
        for k in range(2, self.order + 1):
            if k == 2:
                given = stored[before, 2:]
                own, bucket, place = mapped.pairs(ids[before], last)
            else:
                # the words in front end with the token before, if that is of the same text
                bucket, place = _before(bucket, sizes, 0), _before(place, sizes, -1)
                own, place, given = mapped.longer(k, bucket, place, last)
            total, off = given[:, 0], np.array(self.discounts[k - 1])
            taken = np.array([0.0, *off])[np.minimum(own, 3)]
            p = np.where(total > 0, (own - taken + (given[:, 1:] @ off) * p) / np.maximum(total, 1), p)
        summed = lambda x: np.add.reduceat(x, starts) if len(starts) else x
        base = np.log10((count + 1) / (self.tokens + self.words + 1))
        return summed((count > 0).astype(np.int64)), summed(base), summed(np.log10(p))


def _mounted(spark: SparkSession) -> str:
    path = urlparse(fresh_path(spark, "kneser-ney"))
    if path.scheme not in ("", "file"):
        raise ValueError("memory-mapped arrays need a shared folder that is mounted on all machines")
    os.makedirs(path.path)
    return path.path


def fit_ngrams(docs: DataFrame, order: int = 3, text: str = "text") -> Model:
    """A model of all texts of ``docs`` with n-grams of up to ``order`` (2 or more) words; a null text is one without words.

    The totals that reach the driver are two rows. The arrays lie under
    ``spark.checkpoint.dir``, which must be mounted where the workers run.
    """
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    folder, buckets = _mounted(spark), shuffle_parts(spark)
    texts = docs.select(whole_text(docs, text).alias("text"))
    words = texts.mapInArrow(_count_words(buckets), WORDS).groupBy("bucket").applyInArrow(_sum_vocabulary(folder, buckets), "words long, tokens long")
    sizes = words.agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).first().asDict()
    vocabulary = Mapped(folder, buckets, _files(folder))
    grams = texts.mapInArrow(_count_grams(vocabulary, order), GRAMS)
    for k in range(order, 1, -1):
        grams = grams.groupBy("bucket").applyInArrow(_sum_grams(vocabulary, k, order), GRAMS)
    totals = grams.groupBy("bucket").applyInArrow(_sum_words(folder, order), TOTALS)
    found = [F.sum(F.col("found")[k]).alias(f"found{k}") for k in range(5 * order)]
    row = totals.agg(F.sum("before").alias("before"), *found).first().asDict()
    return Model(folder, buckets, {**sizes, **row, "found": [[row[f"found{5 * k + j}"] or 0 for j in range(5)] for k in range(order)]}, order)


def fit_bigrams(docs: DataFrame, text: str = "text") -> Model:
    return fit_ngrams(docs, 2, text)


SCORE = "n_tokens long, n_known long, base_score double, score double"


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_known``, ``base_score``, ``score`` and ``perplexity``; columns of these names are replaced.

    Scores are log10 probabilities of the whole text with its end; ``base_score``
    is the add-one unigram score. Null and empty texts are an end alone.
    """
    names = [c.split()[0] for c in SCORE.split(", ")]
    kind = pa.struct(list(zip(names, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))))

    @F.arrow_udf(SCORE)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mapped = worker_value(("kneser-ney", model.folder), lambda: Mapped(model.folder, model.buckets, model.files))
        for texts in batches:
            parts = []
            for _, some in _chunks(texts):
                tokens, sizes = token_arrays(some)
                columns = [sizes, *model.scores(mapped, tokens, sizes)]
                parts.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind)))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    kept = docs.drop(*names, "perplexity")
    found = kept.withColumn("_found", score(whole_text(docs, text)))
    return found.select(
        *kept.columns, *[F.col(f"_found.{c}").alias(c) for c in names],
        F.pow(F.lit(10.0), -F.col("_found.score") / F.col("_found.n_tokens")).alias("perplexity"),
    )
