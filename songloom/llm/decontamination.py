"""Documents that hold a benchmark item, found through an embedding of edit distance into Hamming distance.

An item of n words is held if some stretch of the document is within a fifth of
n edits (words put in, left out or changed). Then the item has an unedited run
of a few words, which places a window of the item's size in the document. The
window and the item take the same random walk (at each step the word seen
decides whether to move on), which turns few edits into few differing steps;
steps sampled over repeated walks select windows that agree in one of them. What
is selected is verified by the exact edit distance.

Over many words walks part for good, so a long item is looked for by its parts:
if the whole is within a fifth of its words, some part is within a fifth of its
own. A part that is found places the whole item, which alone is verified.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from songloom.llm.arrays import PUNCTUATION, U, lowered, mixed, together, window_hashes, words_of
from songloom.llm.shared import whole_text, worker_value
from songloom.session import materialized

SAMPLES = 2
# Words of an item that are walked at once; a longer one is cut into even parts.
PART = 40
# Items and parts of a class of sizes that the number of walks is tried on, and walks at most.
TRIED = 4096
WALKS = 1000
SEED_WORDS = 4
CELLS = 1 << 21
# Windows times walks that are walked at once, and words of documents that are looked up at once.
WALKED = 1 << 12
LOOKED_UP = 1 << 16
DOCS_AT_ONCE = 1024


def item_words(text: str) -> np.ndarray:
    """Hashes of the words in lower case; ASCII punctuation only parts words."""
    return words_of([lowered(text)], PUNCTUATION)[0]


def words_of_texts(texts: list[str]) -> list[np.ndarray]:
    """As :func:`item_words`, for each of many texts."""
    out = []
    for raws in together([lowered(t) for t in texts]):
        words, first = words_of(raws, PUNCTUATION)
        out += [words[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    return out


def allowed_edits(words: int, similarity: float) -> int:
    return int((1 - similarity) * words + 1e-9)


def seed_length(words: int, edits: int) -> int:
    """Words of the run that ``edits`` edits leave whole at least, at most SEED_WORDS."""
    return max(1, min(SEED_WORDS, words, -(-(words - edits) // (edits + 1))))


def sampled_steps(sizes: np.ndarray, repeats: range) -> np.ndarray:
    """The steps of each walk that are compared, for windows of the given sizes: below twice the size."""
    share = mixed(np.arange(repeats.start * SAMPLES, repeats.stop * SAMPLES, dtype=U) + U(77)).astype(np.float64) / 2.0**64
    return (share.reshape(-1, SAMPLES).T[:, :, None] * (2 * sizes)).astype(np.int64)


def walks(words: np.ndarray, sizes: np.ndarray, repeats: range) -> np.ndarray:
    """The symbols that each of several walks shows at its sampled steps; ``words`` holds a window per row, padded."""
    at, rows = np.zeros((len(repeats), len(words)), dtype=np.int64), np.arange(len(words))
    steps = sampled_steps(sizes, repeats)
    out = np.zeros((SAMPLES, len(repeats), len(words)), dtype=U)
    last = int(steps.max(initial=0))
    odd = mixed(np.arange(last + 1, dtype=U)[:, None] + (np.array(repeats, dtype=U) << U(32))) | U(1)
    for j in range(last + 1):
        seen = np.where(at < sizes, words[rows, np.minimum(at, words.shape[1] - 1)], U(0))
        for k in range(SAMPLES):
            np.copyto(out[k], seen, where=steps[k] == j)
        at += ((seen * odd[j][:, None]) >> U(63)).astype(np.int64)
    return out


def walk(words: np.ndarray, sizes: np.ndarray, repeat: int) -> np.ndarray:
    return walks(words, sizes, range(repeat, repeat + 1))[:, 0]


def agree(windows: np.ndarray, items: np.ndarray, sizes: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """Whether a window and its item show the same symbols in one of the walks, ``repeats`` for each."""
    done, first, most = np.zeros(len(windows), dtype=bool), 0, int(repeats.max(initial=0))
    while len(left := np.flatnonzero(~done & (first < repeats))):
        # of few windows many walks at once: a step takes its time, however few they are
        own = range(first, min(most, first + max(1, WALKED // len(left))))
        same = walks(windows[left], sizes[left], own) == walks(items[left], sizes[left], own)
        done[left] = (same.all(axis=0) & (np.array(own)[:, None] < repeats[left])).any(axis=0)
        first = own.stop
    return done


def best_place(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any stretch of ``text``, and the first end of such a stretch.

    Bit-parallel: a whole column of the distance table is one integer.
    """
    n, masks = len(pattern), defaultdict(int)
    for i, w in enumerate(pattern):
        masks[w] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, distance, best, end = full, 0, n, n, 0
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up, right_down = down | ~(diagonal | up) & full, up & diagonal
        distance += bool(right_up & top) - bool(right_down & top)
        right_up, right_down = right_up << 1, right_down << 1  # a stretch may start anywhere
        up, down = (right_down | ~(diagonal | right_up)) & full, right_up & diagonal & full
        if distance < best:
            best, end = distance, j
    return best, end


def parts_of(n: int) -> list[tuple[int, int]]:
    """Where an item of ``n`` words is cut: even parts of at most PART words."""
    cuts = np.linspace(0, n, -(-n // PART) + 1).astype(int).tolist()
    return list(zip(cuts[:-1], cuts[1:]))


def size_class(sizes: np.ndarray) -> np.ndarray:
    """Sizes within a factor of about 1.4 share a class, and with it a number of walks."""
    return (2 * np.log2(np.maximum(sizes, 1))).astype(np.int64)


def edited(words: np.ndarray, edits: int, rng) -> np.ndarray:
    """``words`` with random ones changed, put in or left out."""
    out = words.tolist()
    for kind in rng.integers(0, 3, edits).tolist():
        at = int(rng.integers(0, max(1, len(out))))
        out[at:at + (kind != 0)] = [] if kind == 2 else [int(rng.integers(1, 1 << 62))]
    return np.array(out, dtype=U)


class Items:
    """A block of benchmark items with what a worker needs to look for them.

    ``units`` are the items and the parts of long ones: their item, their offset in it and their words.
    """

    def __init__(self, ids: list, texts: list[str], similarity: float, walks: dict[int, int] | None = None):
        words = [item_words(t or "") for t in texts]
        held = [k for k, w in enumerate(words) if len(w)]
        self.ids, self.whole = [ids[k] for k in held], [words[k] for k in held]
        self.edits = [allowed_edits(len(w), similarity) for w in self.whole]
        units = [(k, at, w[at:to]) for k, w in enumerate(self.whole) for at, to in parts_of(len(w))]
        self.item, self.offset, self.words = ([u[j] for u in units] for j in range(3))
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.own_edits = [allowed_edits(n, similarity) for n in self.sizes.tolist()]
        self.seeds = {}
        lengths = [seed_length(n, e) for n, e in zip(self.sizes.tolist(), self.own_edits)]
        for length in sorted(set(lengths)):
            grams = [(k, window_hashes(self.words[k], length)) for k in range(len(units)) if lengths[k] == length]
            hashes = np.concatenate([h for _, h in grams])
            item = np.concatenate([np.full(len(h), k) for k, h in grams])
            place = np.concatenate([np.arange(len(h)) for _, h in grams])
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(hashes >> U(44)).astype(np.int64)] = True
            self.seeds[length] = hashes[order], item[order], place[order], seen
        classes = size_class(self.sizes)
        self.walks = np.array([(walks or {}).get(c, 1) for c in classes.tolist()], dtype=np.int64)

    def calibrated(self, recall: float) -> dict[int, int]:
        """For each class of sizes the walks until ``recall`` of its units agree with all edits allowed."""
        rng, out, classes = np.random.default_rng(0), {}, size_class(self.sizes)
        for c in np.unique(classes).tolist():
            own = np.flatnonzero(classes == c)
            chosen = own[np.linspace(0, len(own) - 1, min(TRIED, len(own))).astype(int)]
            units = np.repeat(chosen, max(4, -(-256 // len(chosen)))).tolist()
            sizes = self.sizes[units]
            left, right = self._padded(self.words, units), np.zeros((len(units), int(sizes.max())), dtype=U)
            for row, k in enumerate(units):
                w = edited(self.words[k], self.own_edits[k], rng)
                right[row, : min(len(w), sizes[row])] = w[: sizes[row]]
            done, repeat = np.zeros(len(units), dtype=bool), 0
            while done.mean() < recall:
                if repeat == WALKS:
                    raise ValueError("the recall asked for is out of reach")
                rest = np.flatnonzero(~done)
                done[rest] = (walk(right[rest], sizes[rest], repeat) == walk(left[rest], sizes[rest], repeat)).all(axis=0)
                repeat += 1
            out[c] = max(1, repeat)
        return out

    @staticmethod
    def _padded(words: list[np.ndarray], items: list[int]) -> np.ndarray:
        out = np.zeros((len(items), max(len(words[k]) for k in items)), dtype=U)
        for row, k in enumerate(items):
            out[row, : len(words[k])] = words[k]
        return out

    def proposed(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, items and places of their windows, from runs of words that they share."""
        found, sizes, at = [np.empty((3, 0), np.int64)], [len(d) for d in docs], 0
        while at < len(docs):
            to, size = at + 1, sizes[at]
            while to < len(docs) and size + sizes[to] <= LOOKED_UP:
                size += sizes[to]
                to += 1
            words, first = np.concatenate(docs[at:to]), np.cumsum([0, *sizes[at:to]])
            for length, (hashes, of, place, seen) in self.seeds.items():
                own = window_hashes(words, length)
                spots = np.flatnonzero(seen[(own >> U(44)).astype(np.int64)])
                low, high = np.searchsorted(hashes, own[spots], "left"), np.searchsorted(hashes, own[spots], "right")
                doc = np.searchsorted(first, spots, "right") - 1
                n = np.where(spots + length <= first[doc + 1], high - low, 0)  # no run goes over to the next document
                which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append(np.stack([np.repeat(at + doc, n), of[which], np.repeat(spots - first[doc], n) - place[which]]))
            at = to
        doc, item, start = np.unique(np.concatenate(found, axis=1), axis=1)
        return doc, item, start

    def agreeing(self, docs: list[np.ndarray], doc: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which proposals agree with their item in some walk."""
        out, order, at = np.zeros(len(item), dtype=bool), np.argsort(self.sizes[item], kind="stable"), 0
        while at < len(order):
            # sorted by size: as many windows at once as fit into the cells
            width = int(self.sizes[item[order[at]]])
            take = max(1, CELLS // (2 * max(width, 1)))
            own = order[at:at + take]
            fits = self.sizes[item[own]] <= 2 * width
            own = own[: int(fits.sum())]
            sizes = self.sizes[item[own]]
            windows = np.zeros((len(own), int(sizes.max())), dtype=U)
            for row, (d, s, n) in enumerate(zip(doc[own].tolist(), start[own].tolist(), sizes.tolist())):
                part = docs[d][max(s, 0): s + n]
                windows[row, max(-s, 0): max(-s, 0) + len(part)] = part
            out[own] = agree(windows, self._padded(self.words, item[own].tolist()), sizes, self.walks[item[own]])
            at += len(own)
        return out

    def found(self, docs: list[np.ndarray]) -> list[list[dict]]:
        """For each document its items with the best stretch of each."""
        out: list[list[dict]] = [[] for _ in docs]
        doc, item, start = self.proposed(docs)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        searched: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for k in np.flatnonzero(self.agreeing(docs, doc, item, start)).tolist():
            d, i, s = int(doc[k]), self.item[int(item[k])], int(start[k]) - self.offset[int(item[k])]
            n, edits = len(self.whole[i]), self.edits[i]
            if best.get((d, i), (1,))[0] == 0 or any(low <= s - 3 * edits and s + n + 3 * edits <= high for low, high in searched[d, i]):
                continue
            searched[d, i].append((s - 4 * edits, s + n + 4 * edits))
            low = max(0, s - 4 * edits)
            region, pattern = docs[d][low: max(0, s + n + 4 * edits)].tolist(), self.whole[i].tolist()
            distance, end = best_place(pattern, region)
            if distance <= edits:
                _, back = best_place(pattern[::-1], region[:end][::-1])
                place = (distance, low + end - back, low + end)
                best[d, i] = min(place, best.get((d, i), place))
        for (d, i), (distance, first, end) in sorted(best.items()):
            out[d].append({"item_id": self.ids[i], "start": first, "end": end, "distance": distance})
        return out


LEAKS = "array<struct<item_id:long,start:int,end:int,distance:int>>"


def _item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> list[DataFrame]:
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), whole_text(items, text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) for k in range(blocks)]


def with_leaks(
    docs: DataFrame, items: DataFrame, similarity: float = 0.8, recall: float = 0.998, text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = 16_000_000, out: str = "leaks",
) -> DataFrame:
    """``docs`` with the benchmark items that each whole text holds.

    ``leaks`` lists item, stretch (word numbers, end exclusive) and edit distance,
    the best stretch of each item, in order of item. Words are lower-cased; ASCII punctuation only
    parts them. Null and empty texts hold nothing, items without words are held
    by nothing; repeated items are each reported. A column named ``out`` is
    replaced. ``recall`` is demanded of items (and parts of long ones) in each
    class of sizes, with random edits, as many as are allowed.

    Items are looked for in blocks of about ``block_bytes``. A block is held by
    the driver and by each worker for one pass over the texts, whatever the
    number of blocks; with several, what is found is written and joined by the
    text's hash. With one, texts are not moved.
    """
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())]))

    def search(block: DataFrame):
        own = block.orderBy("item_id", "text").toArrow()
        ids, texts = own["item_id"].to_pylist(), own["text"].to_pylist()
        walks = Items(ids, texts, similarity).calibrated(recall)

        @F.arrow_udf(LEAKS)
        def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = worker_value(("items", similarity, recall, tuple(ids), tuple(texts)), lambda: Items(ids, texts, similarity, walks))
            for texts_of in batches:
                rows = []
                for at in range(0, len(texts_of), DOCS_AT_ONCE):
                    rows += known.found(words_of_texts(texts_of.slice(at, DOCS_AT_ONCE).to_pylist()))
                yield pa.array(rows, kind)

        # a deterministic function would be run once more for a filter on its result
        return find.asNondeterministic()(whole_text(docs, text))

    blocks = _item_blocks(items, item_id, item_text, block_bytes)
    if len(blocks) == 1:
        return docs.withColumn(out, search(blocks[0]))
    keys = [F.xxhash64(whole_text(docs, text)), F.xxhash64(F.lit("second"), whole_text(docs, text))]
    found = []
    for block in blocks:
        rows = docs.select(*[k.alias(f"_t{j}") for j, k in enumerate(keys)], search(block).alias("_found")).where(F.size("_found") > 0)
        found.append(materialized(rows.dropDuplicates(["_t0", "_t1"]), "leaks"))
    every = reduce(DataFrame.unionByName, found).groupBy("_t0", "_t1").agg(F.array_sort(F.flatten(F.collect_list("_found"))).alias("_found"))
    joined = docs.drop(out).join(every, (keys[0] == F.col("_t0")) & (keys[1] == F.col("_t1")), "left")
    return joined.withColumn(out, F.coalesce("_found", F.array().cast(LEAKS))).drop("_t0", "_t1", "_found")
