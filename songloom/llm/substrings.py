"""Removal of word sequences that a document of a smaller id holds as well.

Windows are found level by level: those repeated at one length alone are
extended to about twice that length, up to the length asked for. At the first
level only picked windows are compared: the least hash of every stretch, chosen
alike in equal passages, so each longer window holds at least one of them.

Documents are dealt into groups by id, moved once, and every level works on
whole groups: a group names each of its windows once, whatever the number of its
documents that hold it, so a passage in a third of all documents costs one entry
per group. Hashes meet in buckets by value, and what survives goes back to the
groups that named it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from songloom.llm.arrays import U, from_planes, picked, planes, sliding, window_hashes, word_hashes, word_spans
from songloom.llm.shared import shuffle_parts, whole_text

# Windows of this length or less start the ladder.
SHORT = 8
CHECK_STEP = 0xA0761D6478BD642F
SENT = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("sent", pa.binary())])
BACK = pa.schema([("g", pa.int32()), ("back", pa.binary())])


def ladder(window: int) -> list[int]:
    """Lengths of the levels: halves of ``window``, rounded up, from short to long."""
    out = [window]
    while out[0] > SHORT:
        out.insert(0, -(-out[0] // 2))
    return out


def _members(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places in sorted ``known``, -1 for others."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _alive(words: np.ndarray, lengths: list[int], level: int, survivors: np.ndarray) -> np.ndarray:
    """Positions whose window of ``lengths[level]`` can still repeat, from what survived one level below."""
    long, short = lengths[level], lengths[level - 1]
    hashes = window_hashes(words, short)
    n = len(words) - long + 1
    if n < 1:
        return np.empty(0, dtype=np.int64)
    if level == 1:  # the least hash inside was picked wherever the window stands
        least = sliding(hashes, long - short + 1, np.minimum)
        return np.flatnonzero(_members(least | U(1), survivors) >= 0)
    good = _members(hashes | U(1), survivors) >= 0
    return np.flatnonzero(good[:n] & good[long - short:][:n])


def _docs(table: pa.Table):
    """``(id, bytes, starts, ends, word hashes)`` of each document; a null id counts as the least."""
    ids = table["id"].to_pylist()
    for at in range(0, len(ids), 64):
        for doc_id, text in zip(ids[at:at + 64], table["text"].slice(at, 64).to_pylist()):
            raw = text.encode()
            starts, ends = word_spans(raw)
            yield -(1 << 63) if doc_id is None else doc_id, raw, starts, ends, word_hashes(raw, starts, ends)


def _windows(words: np.ndarray, lengths: list[int], level: int, survivors: np.ndarray | None) -> np.ndarray:
    """Positions that ask about their window at this level."""
    n = len(words) - lengths[level] + 1
    if n < 1:
        return np.empty(0, dtype=np.int64)
    if level:
        return _alive(words, lengths, level, survivors)
    if len(lengths) > 1:
        return picked(window_hashes(words, lengths[0]), lengths[1] - lengths[0] + 1)
    return np.arange(n)


def _check(words: np.ndarray, length: int) -> np.ndarray:
    """32 more bits of each window's hash."""
    return (window_hashes(words ^ U(CHECK_STEP), length, CHECK_STEP) >> U(32)).astype(np.uint32)


def _survivors(back: pa.Table | None) -> np.ndarray:
    parts = [np.frombuffer(b, "<u8") for b in back["back"].to_pylist()] if back is not None else []
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, dtype=U)


def _ask(lengths: list[int], level: int, buckets: int):
    """The windows of a group at one level, one entry each, dealt into buckets by hash."""
    last = level == len(lengths) - 1

    def ask(docs: pa.Table, back: pa.Table | None) -> pa.Table:
        survivors = _survivors(back)
        hashes, checks, owners = [np.empty(0, U)], [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for doc_id, _, _, _, words in _docs(docs):
            spots = _windows(words, lengths, level, survivors)
            own = window_hashes(words, lengths[level])[spots]
            if last:
                checks.append(_check(words, lengths[level])[spots])
            else:
                own = np.unique(own)
            hashes.append(own)
            owners.append(np.full(len(own), doc_id))
        h, doc = np.concatenate(hashes), np.concatenate(owners)
        check = np.concatenate(checks) if last else np.zeros(len(h), np.uint32)
        # the lowest bit tells whether two documents of the group hold the window
        h = h & ~U(1)
        order = np.lexsort((doc, check, h)) if last else np.argsort(h, kind="stable")
        h, check, doc = h[order], check[order], doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
        first = np.flatnonzero(new)
        if len(h):
            many = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
            h, check, doc = h[first] | many.astype(U), check[first], doc[first]
        bucket = ((h >> U(32)) * U(buckets)) >> U(32)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U))
        rows = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
        sent = [h[cuts[k]:cuts[k + 1]].tobytes() for k in rows]
        if last:
            sent = [
                s + check[cuts[k]:cuts[k + 1]].tobytes() + planes(doc[cuts[k]:cuts[k + 1]]) for k, s in zip(rows, sent)
            ]
        g = docs["g"][0].as_py() if len(docs) else 0
        return pa.table([pa.array(rows, pa.int32()), pa.array([g] * len(rows), pa.int32()), pa.array(sent, pa.binary())], schema=SENT)

    return ask if level else lambda docs: ask(docs, None)


def _meet(asked: pa.Table) -> pa.Table:
    """Of the windows of one bucket those that two documents hold, sent back to the groups that named them."""
    parts = [np.frombuffer(s, "<u8") for s in asked["sent"].to_pylist()]
    groups = asked["g"].to_pylist()
    whole = np.concatenate(parts)
    bare = whole & ~U(1)
    values, counts = np.unique(bare, return_counts=True)
    shared = np.union1d(values[counts > 1], bare[(whole & U(1)) == 1])
    back = [(g, own[_members(own & ~U(1), shared) >= 0] | U(1)) for g, own in zip(groups, parts)]
    back = [(g, own.tobytes()) for g, own in back if len(own)]
    return pa.table([pa.array([g for g, _ in back], pa.int32()), pa.array([b for _, b in back], pa.binary())], schema=BACK)


def _unpacked(sent: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(sent) // 20
    return np.frombuffer(sent, "<u8", n), np.frombuffer(sent, "<u4", n, 8 * n), from_planes(sent[12 * n:])


def _meet_last(asked: pa.Table) -> pa.Table:
    """For each window of one bucket the least id that holds it, for groups with a greater one."""
    parts = [_unpacked(s) for s in asked["sent"].to_pylist()]
    group = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    h, check, doc = (np.concatenate(x) for x in zip(*parts))
    bare = h & ~U(1)
    order = np.lexsort((doc, check, bare))
    bare, check, doc, group, many = bare[order], check[order], doc[order], group[order], (h[order] & U(1)) == 1
    new = np.ones(len(bare), dtype=bool)
    new[1:] = (bare[1:] != bare[:-1]) | (check[1:] != check[:-1])
    first = np.flatnonzero(new)
    least = np.repeat(doc[first], np.diff(np.append(first, len(bare))))
    told = np.flatnonzero(many | (least < doc))
    told = told[np.argsort(group[told], kind="stable")]
    cuts = np.searchsorted(group[told], np.arange(len(parts) + 1))
    ids, back = asked["g"].to_pylist(), []
    for k in range(len(parts)):
        own = told[cuts[k]:cuts[k + 1]]
        if len(own):
            back.append((ids[k], bare[own].tobytes() + check[own].tobytes() + planes(least[own])))
    return pa.table([pa.array([g for g, _ in back], pa.int32()), pa.array([b for _, b in back], pa.binary())], schema=BACK)


REMOVED = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", REMOVED), ("kept", pa.string())])


def _remove(lengths: list[int]):
    window = lengths[-1]

    def remove(docs: pa.Table, back: pa.Table) -> pa.Table:
        parts = [_unpacked(b) for b in back["back"].to_pylist()]
        h, check, least = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, U), np.empty(0, np.uint32), np.empty(0, np.int64))
        order = np.lexsort((check, h))
        h, check, least = h[order], check[order], least[order]
        rows = []
        for (doc_id, raw, starts, ends, words), shown in zip(_docs(docs), docs["id"].to_pylist()):
            own = window_hashes(words, window) & ~U(1)
            spots = np.flatnonzero(_members(own, h) >= 0)
            hit = np.zeros(len(spots), dtype=bool)
            if len(spots):
                own_check, at = _check(words, window)[spots], np.searchsorted(h, own[spots])
                live = np.arange(len(spots))
                while len(live):  # entries of equal hash lie together; nearly always there is one
                    hit[live] |= (check[at[live]] == own_check[live]) & (least[at[live]] < doc_id)
                    at[live] += 1
                    live = live[at[live] < len(h)]
                    live = live[h[at[live]] == own[spots][live]]
            spots = spots[hit]
            if not len(spots):
                rows.append((shown, len(starts), 0, [], b" ".join(raw.split()).decode()))
                continue
            edge = np.zeros(len(starts) + 2, dtype=np.int64)
            np.add.at(edge, spots + 1, 1)
            np.add.at(edge, spots + window + 1, -1)
            covered = edge.cumsum() > 0
            turns = np.flatnonzero(covered[1:] != covered[:-1])
            covered = covered[1:-1]
            spans = [{"start": a, "end": b} for a, b in zip(turns[::2].tolist(), turns[1::2].tolist())]
            left = np.flatnonzero(~covered)
            kept = b" ".join([raw[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist())])
            rows.append((shown, len(starts), int(covered.sum()), spans, kept.decode()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), RESULT.types)] if rows else [pa.array([], t) for t in RESULT.types], schema=RESULT)

    return remove


def without_repeats(
    docs: DataFrame, window: int = 13, groups_per_partition: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n_words, n_removed, removed, kept)``: each text without repeated passages.

    Words are runs without ASCII blanks, unchanged. Every word is removed that
    lies in a window of ``window`` words which also starts in a document with a
    smaller id; windows are judged on the input. ``removed`` lists the removed
    stretches by word number, end exclusive; ``kept`` joins the other words by
    one space. Null and empty texts have no words. Rows of equal id don't count
    against each other; a null id is smaller than all others. Windows are told
    apart by 95 bits of hashes.
    """
    if window < 1:
        raise ValueError("window must be one or more")
    buckets = shuffle_parts(docs.sparkSession)
    lengths, parts = ladder(window), buckets * groups_per_partition
    key = F.col(doc_id).cast("long")
    own = docs.select(
        F.pmod(F.xxhash64(F.coalesce(key, F.lit(-1))), F.lit(parts)).cast("int").alias("g"), key.alias("id"),
        whole_text(docs, text).alias("text"),
    )
    grouped, back = own.groupBy("g"), None
    for level in range(len(lengths)):
        last = level == len(lengths) - 1
        named = grouped.cogroup(back.groupBy("g")) if level else grouped
        asked = named.applyInArrow(_ask(lengths, level, buckets), "bucket int, g int, sent binary")
        back = asked.groupBy("bucket").applyInArrow(_meet_last if last else _meet, "g int, back binary")
    return grouped.cogroup(back.groupBy("g")).applyInArrow(
        _remove(lengths), "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"
    )
