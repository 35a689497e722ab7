"""Byte-level BPE with a sentencepiece model serialised from a rank file.

Every byte is written as one printable character, so a token of the rank file is
a sentencepiece piece over those characters; its score is its negative rank.
Both algorithms then merge the adjacent pair of the best rank, leftmost first,
so each pre-token gets the ids of the rank file.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from songloom.llm.shared import worker_value

# A pre-token of more bytes is encoded each time and not remembered.
REMEMBERED_BYTES = 48
# Pre-tokens in each half of what is remembered.
REMEMBERED = 75_000
# Rows and bytes of text that are encoded at once.
ROWS, BYTES = 256, 1 << 20
# The pattern whose matches are found over whole batches; others are run on each text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK, LETTER, NUMBER, OTHER = range(4)


def byte_characters() -> list[str]:
    """One printable character per byte, the same for all that are printable already."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol buffer field: bytes, a varint or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """The serialised model, and for each piece its rank (-1 for the unknown piece, which never occurs).

    All 256 single bytes must be tokens. Scores are 32-bit floats, exact up to 2**24 ranks.
    """
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    if max(ranks.values()) >= 1 << 24:
        raise ValueError("ranks beyond 2**24 have no exact score")
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    ordered = sorted(ranks.items(), key=lambda x: x[1])
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)]
    pieces += [
        _field(1, "".join(chars[b] for b in token).encode()) + _field(2, -float(rank)) + _field(3, normal)
        for token, rank in ordered
    ]
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, 0) + b"".join(
        _field(k, (1 << 64) - 1) for k in (41, 42, 43)  # no begin, end or padding piece
    )
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    model = b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)
    return model, np.array([-1, *(r for _, r in ordered)], dtype=np.int64)


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """Bytes of each id: the inverse of the ranks, empty for ids without a token."""
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def decode_ids(packed: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def char_kinds() -> np.ndarray:
    """For each code point whether the ``regex`` library takes it as BLANK, LETTER, NUMBER or OTHER."""
    import regex

    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = 0  # surrogates are in no text
    every, out = points.tobytes().decode("utf-32-le"), np.full(len(points), OTHER, dtype=np.uint8)
    for kind, pattern in ((BLANK, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for found in regex.finditer(pattern, every):
            out[found.start():found.end()] = kind
    return out


def word_starts(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the matches of WORDS begin in texts that lie one behind the other, as UTF-8; every byte is in a match.

    A match is a run of one kind with the space in front of it. Of blanks before
    another kind, all but the last are a match, and the last one is if it is no
    space. A contraction counts where its apostrophe begins a match.
    """
    n = len(data)
    padded = np.zeros(n + 4, dtype=np.uint8)
    padded[:n] = data
    kind = kinds[padded]
    lead = np.flatnonzero(padded >= 0xC0)
    more = (padded[lead] >= 0xE0).astype(np.int64) + (padded[lead] >= 0xF0)
    point = padded[lead].astype(np.int64) & (0x1F >> more)
    for k in range(1, 4):
        own = more >= k - 1
        point[own] = point[own] << 6 | padded[lead[own] + k] & 0x3F
    own_kind = kinds[point]
    for k in range(4):
        own = more >= k - 1
        kind[lead[own] + k] = own_kind[own]
    text_start = np.zeros(n + 4, dtype=bool)
    text_start[offsets] = True
    starts = text_start.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    word = np.flatnonzero(starts[:n] & (kind[:n] != BLANK) & ~text_start[:n])
    word = word[kind[word - 1] == BLANK]
    last = word - 1
    starts[word[padded[last] == 32]] = False
    while (inside := padded[last] & 0xC0 == 0x80).any():
        last = last - inside
    starts[last] = True
    quote = np.flatnonzero((padded == 39) & starts)
    quote = quote[~text_start[quote + 1]]
    one, two = padded[quote + 1], padded[quote + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)  # re, ve, ll
    long &= ~text_start[quote + 2]
    starts[quote[short | long] + 1] = False
    for found, size in ((quote[short], 2), (quote[long], 3)):
        starts[found + size] |= kind[found + size] == LETTER
    return np.flatnonzero(starts[:n])


def _joined(values: pa.Array, first: np.ndarray) -> pa.Array:
    """The bytes of ``values`` joined: those of the first, second, .. row begin at ``first``, which has one number more."""
    _, ends, data = values.buffers()
    offsets = np.frombuffer(ends, np.int32)[values.offset:][first] if len(values) else np.zeros(len(first), np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(offsets.tobytes()), data or pa.py_buffer(b"")])


class Encoder:
    """Encodes in one worker; built once per worker from the rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.whole = read_ranks(path)
        self.tokens = pa.array(token_bytes(self.whole), pa.binary())
        model, self.rank_of = model_bytes(self.whole)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.kinds = char_kinds() if pattern == WORDS else None
        self.chars = dict(enumerate(byte_characters()))
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pre-tokens of all texts, and the number of the first of each text, with their whole number behind."""
        if self.kinds is None:
            parts = [self.split(t) for t in texts.to_pylist()]
            first = np.cumsum([0, *map(len, parts)])
            return pa.array([p.encode() for own in parts for p in own], pa.binary()), first
        _, ends, data = texts.buffers()
        offsets = np.frombuffer(ends, np.int32)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]]
        starts = word_starts(raw, offsets - offsets[0], self.kinds)
        first = np.searchsorted(starts, offsets - offsets[0])
        ends = np.append(starts, len(raw)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)]), first

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        """Ids of new pre-tokens, packed."""
        ranks = list(map(self.whole.get, parts))  # a pre-token that is a token stays whole
        mapped = [p.decode("latin-1").translate(self.chars) for p, rank in zip(parts, ranks) if rank is None]
        found = self.processor.encode(mapped, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        packed = self.rank_of[np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))].astype("<u4").tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        own = iter([packed[a:b] for a, b in zip([0, *ends], ends)])
        return [next(own) if rank is None else struct.pack("<I", rank) for rank in ranks]

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        """Ids of different pre-tokens, packed. What is remembered makes two halves, and the one used less lately goes."""
        found = list(map(self.known.get, parts))
        late = [k for k, ids in enumerate(found) if ids is None]
        for k in late:
            found[k] = self.older.get(parts[k])
        new = [k for k in late if found[k] is None]
        for k, ids in zip(new, self._learn([parts[k] for k in new]) if new else []):
            found[k] = ids
        if len(self.known) + len(late) > REMEMBERED:
            self.older, self.known = self.known, {}
        self.known.update((parts[k], found[k]) for k in late if len(parts[k]) <= REMEMBERED_BYTES)
        return found

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text as packed little-endian unsigned 32-bit integers."""
        parts, first = self._cut(texts)
        coded = parts.dictionary_encode()
        packed = pa.array(self._ids(coded.dictionary.to_pylist()), pa.binary()).take(coded.indices)
        return _joined(packed, first)

    def decode(self, packed: pa.Array) -> pa.Array:
        """The bytes that the ids of each row stand for."""
        _, ends, data = packed.buffers()
        offsets = np.frombuffer(ends, np.int32)[packed.offset:packed.offset + len(packed) + 1]
        ids = np.frombuffer(data or b"", "<u4", (offsets[-1] - offsets[0]) // 4, offsets[0]) if offsets[-1] > offsets[0] else np.empty(0, "<u4")
        return _joined(self.tokens.take(pa.array(ids)), (offsets - offsets[0]) // 4)


def _pieces(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """A batch and its texts in pieces of up to ROWS rows and, of several rows, about BYTES bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else []
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, min(at + ROWS, int(np.searchsorted(ends, before + BYTES, "right"))))
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to


def _binary(values: pa.Array, one) -> pa.Array:
    """``one`` of each value, taken out of Arrow a few at a time so that a batch is never held twice."""
    out = [pa.array([one(x) for x in values.slice(at, 256).to_pylist()], pa.binary()) for at in range(0, len(values), 256)]
    return pa.concat_arrays(out) if out else pa.array([], pa.binary())


def bpe_encode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None
) -> DataFrame:
    """``docs`` with the ids of each whole text in ``out``.

    The ids are packed as little-endian unsigned 32-bit integers; :func:`unpacked_ids`
    gives an array. Each match of ``pattern`` is encoded on its own, without
    special tokens. A null or empty text gets no ids; a column named ``out`` is
    replaced; rows are kept as they are, repeated ones too. ``path`` names the
    rank file, which every worker reads where it is installed. ``decoded`` names
    a column for the bytes that the ids stand for, for callers that check the
    round trip: it is then made in the same pass, by the same worker.
    """
    added = [out] + ([decoded] if decoded else [])
    rows = docs.drop(*added).withColumn(text, F.col(text).cast("string"))
    names, place = rows.columns, rows.columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_value(("bpe", path, pattern), lambda: Encoder(path, pattern))
        for batch in batches:
            whole = batch.column(place).cast(pa.string()).fill_null("")
            for part, texts in _pieces(batch, whole):  # small batches go back, so none is held twice
                ids = encoder.encode(texts)
                columns = [*part.columns, ids] + ([encoder.decode(ids)] if decoded else [])
                yield pa.RecordBatch.from_arrays(columns, names + added)

    schema = StructType([*rows.schema.fields, *[StructField(c, BinaryType()) for c in added]])
    return rows.mapInArrow(encode, schema)


def bpe_decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that packed ids stand for; null ids give no bytes."""
    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = worker_value(("bpe tokens", path), lambda: token_bytes(read_ranks(path)))
        for packed in batches:
            yield _binary(packed, lambda x: decode_ids(x, tokens))

    return docs.withColumn(out, decode(F.coalesce(F.col(ids), F.lit(b""))))


def token_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def unpacked_ids(docs: DataFrame, ids: str = "ids") -> DataFrame:
    """``docs`` with packed ids as an array of integers."""
    @F.pandas_udf("array<int>")
    def unpack(packed: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x or b"", "<u4").astype(np.int32) for x in packed], dtype=object)

    return docs.withColumn(ids, unpack(F.col(ids)))
