"""Words of a text and their hashes as arrays: the numeric part of several operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
# Multipliers of the hashes, any odd 64-bit numbers.
BYTE_STEP = 0x9E3779B97F4A7C15
WORD_STEP = 0xD6E8FEB86659FD93
# Bytes of a text that are hashed at once.
PIECE = 1 << 18
# Bytes of short texts that are taken together.
TOGETHER = 1 << 16
LONG_WORD = 256

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
# everything of ASCII but letters and digits
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = bytes(ord(chr(b).lower()) for b in range(256))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(BYTE_STEP, PIECE)
_DOWN = _powers(pow(BYTE_STEP, -1, 1 << 64), PIECE)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def lowered(text: str) -> bytes:
    """UTF-8 of the text in lower case."""
    try:
        return text.encode("latin-1").translate(_LOWER).decode("latin-1").encode()
    except UnicodeEncodeError:
        return text.lower().encode()


def together(raws: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in lists of a few, so that arrays over a list are neither many nor large."""
    at, size = 0, 0
    for k, raw in enumerate(raws, 1):
        size += len(raw) + 1
        if size >= TOGETHER or k == len(raws):
            yield raws[at:k]
            at, size = k, 0


def word_spans(raw: bytes, blanks: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII blanks, or without other bytes that count as blank."""
    blank = np.ones(len(raw) + 2, dtype=bool)
    blank[1:-1] = np.frombuffer(raw.translate(blanks.tobytes()), bool)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, taken from running sums."""
    data, out, at = np.frombuffer(raw, np.uint8), np.empty(len(starts), dtype=U), 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + PIECE, "right")))
        high = min(int(ends[to - 1]), low + PIECE)
        sums = np.zeros(high - low + 1, dtype=U)
        sums[1:] = data[low:high]
        sums[1:] += U(1)
        sums[1:] *= _UP[: high - low]
        np.cumsum(sums, out=sums)
        first, last = starts[at:to] - low, np.minimum(ends[at:to] - low, high - low)
        out[at:to] = (sums[last] - sums[first]) * _DOWN[first]
        at = to
    lengths = ends - starts
    for k in np.flatnonzero(lengths > LONG_WORD).tolist():
        import xxhash

        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k]:ends[k]])
    return mixed(out + lengths.astype(U) * U(WORD_STEP))


def words_of(raws: list[bytes], blanks: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the number of the first of each text, with their whole number behind."""
    raw = b" ".join(raws)
    starts, ends = word_spans(raw, blanks)
    first = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))
    return word_hashes(raw, starts, ends), first


def window_hashes(words: np.ndarray, length: int, step: int = WORD_STEP) -> np.ndarray:
    """A hash of every window of ``length`` consecutive values, built by doubling."""
    n = len(words) - length + 1
    if n < 1:
        return np.empty(0, dtype=U)
    done, size = None, 0
    block, width = words, 1
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            # the part so far moves up behind the new block
            done = block[:] if done is None else block[: len(done) - width] * U(pow(step, size, 1 << 64)) + done[width:]
            size += width
        if length >> (bit + 1):
            block = block[:-width] * U(pow(step, width, 1 << 64)) + block[width:]
            width *= 2
    return mixed(done[:n])


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over every window of ``width`` values."""
    done, size = values, 1
    while size < width:
        move = min(size, width - size)
        done = best(done[:-move], done[move:]) if len(done) > move else done[:0]
        size += move
    return done


def picked(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions whose hash is the least of some ``width`` consecutive ones.

    Every stretch of ``width`` hashes holds a picked one, and equal stretches pick
    at equal places, so few positions stand for all.
    """
    if len(hashes) < width:
        return np.empty(0, dtype=np.int64)
    least = sliding(hashes, width, np.minimum)
    edge = np.zeros(width - 1, dtype=U)
    return np.flatnonzero(hashes == sliding(np.concatenate([edge, least, edge]), width, np.maximum))


def planes(values: np.ndarray) -> bytes:
    """Little-endian bytes of 64-bit values, all first bytes first: small values then compress well."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def narrow(values: np.ndarray) -> bytes:
    """Values below 2**32 as 32-bit ones, all first bytes first: small values compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
