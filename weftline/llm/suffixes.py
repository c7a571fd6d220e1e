"""Suffix-array dedup: remove every byte covered by a 100-byte string that also starts earlier.

Suffixes are range-partitioned by the leading bytes of their anchor at sampled splitters (see `anchors`); each bucket
orders the bytes from its anchors on, and those before them read backwards, by a multikey quicksort over eight bytes at a time.
Windows that agree on their bytes on both sides of the anchor form a class, of which the first start stays. Splitters part anchors,
and equal strings have equal anchors, so no class crosses a boundary between buckets and nothing is left to compare there.
Strings at anchors with very many surroundings are dealt out one by one and compared by 128-bit digests.

Null and empty texts have no byte. "Earlier" is a smaller id, or an earlier start in the same document; null ids
come last, and of rows that repeat an id equal starts count as one. Strings never cross documents. Very long texts are
taken whole, in one group. An empty table gives no rows. Other columns, whatever their names, are ignored by
`repeated_bytes` and kept by `drop_repeated`.
"""

from __future__ import annotations

from dataclasses import replace
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftline.llm.anchors import Group, Method, Segments, deduplicate, steps
from weftline.llm.common import id_and_text, unwrapped, utf8, wrapped

WINDOW = 100


def read(texts: pa.Array):
    data, ends = utf8(texts)
    return data, ends, None


def lead(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    out = np.zeros(len(place), np.uint64)
    for i in range(4):
        out = out << np.uint64(8) | codes[place + i].astype(np.uint64)
    return out


def multikey_quicksort(data: np.ndarray, start: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Order suffixes by group and then by their first `size` bytes; equal ones get equal class numbers.

    Eight bytes are one key. All parts are split at once, each into smaller, equal and larger keys than that of its
    middle suffix; the equal ones go on with their next eight bytes. A part of one suffix, or one that is equal in all bytes, is done.
    """
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    keys = np.ndarray((len(data) + 1,), ">u8", pad.tobytes(), strides=(1,))
    order = np.argsort(group, kind="stable")
    head = np.ones(len(order), bool)  # first of its class
    head[1:] = np.diff(group[order]) != 0
    first = np.flatnonzero(head)
    n, depth = np.diff(np.append(first, len(order))), np.zeros(len(first), np.int64)
    while True:
        live = (n > 1) & (depth < size)
        first, n, depth = first[live], n[live], depth[live]
        if not len(first):
            break
        base = np.cumsum(n) - n
        within = steps(n)
        at = np.repeat(first, n) + within
        suffix = order[at]
        key = keys[start[suffix] + np.repeat(depth, n)].astype(np.uint64)
        key >>= np.repeat(8 * np.maximum(0, 8 - size + depth), n).astype(np.uint64)
        pivot = np.repeat(key[base + n // 2], n)
        less, same = key < pivot, key == pivot
        n_less, n_same = np.add.reduceat(less, base, dtype=np.int64), np.add.reduceat(same, base, dtype=np.int64)
        before = []  # how many of a kind stand before each suffix in its part
        for mark in (less, same):
            count = np.cumsum(mark) - mark
            before.append(count - np.repeat(count[base], n))
        below = np.repeat(n_less, n)
        spot = np.where(less, before[0], np.where(same, below + before[1], below + np.repeat(n_same, n) + within - before[0] - before[1]))
        order[np.repeat(first, n) + spot] = suffix
        parts = np.stack([n_less, n_same, n - n_less - n_same], axis=1)
        begins = np.stack([first, first + n_less, first + n_less + n_same], axis=1)
        depth = (depth[:, None] + np.array([0, 8, 0])).reshape(-1)
        first, n = begins.reshape(-1), parts.reshape(-1)
        head[first[n > 0]] = True
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(head) - 1
    return order, number


def ordered(data: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `size` bytes, and how many of these each shares with the one before it (the first: all)."""
    padded = np.concatenate([data, np.zeros(size, np.uint8)])
    order, _ = multikey_quicksort(padded, start, np.zeros(len(start), np.int64), size)
    rows = np.lib.stride_tricks.sliding_window_view(padded, size)[start[order]]
    differ = rows[1:] != rows[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
    return order, np.append(size, shared)


def earlier_starts(segments: Segments, method: Method) -> np.ndarray:
    """For every window of every segment, whether an equal window has an earlier start.

    Only anchors are sorted: by the bytes from the anchor on, and by those before it, read backwards. A window with its anchor
    at an offset equals another one with the same offset if they agree on so many bytes before the anchor and on the rest from there on;
    in either order, those that agree on a number of bytes stand side by side. What lies beyond a segment is read as well, and asked by no window.
    """
    data, w = segments.data.reshape(-1), method.window
    windows = segments.tokens.astype(np.int64) - w + 1
    # Segments of several groups that are equal are compared once.
    begin = np.cumsum(segments.tokens, dtype=np.int64) - segments.tokens
    raw, seen = data.tobytes(), {}
    same = np.array([seen.setdefault((raw[s : s + n], a), len(seen)) for s, n, a in zip(begin.tolist(), segments.tokens.tolist(), segments.anchor.tolist(), strict=True)], np.int64)
    # A document and a start in it are one number, in their order.
    starts = (np.unique(segments.doc, return_inverse=True)[1].astype(np.int64) << 42) + segments.place
    order = np.lexsort((starts, same))
    first = order[np.flatnonzero(np.diff(same[order], prepend=-1))]
    n, anchor, start = windows[first], segments.anchor[first].astype(np.int64), starts[first]
    base = np.cumsum(n) - n
    place = begin[first] + anchor
    turn, on = ordered(data, place, w)
    back, before = ordered(data[::-1], len(data) - place, w - method.gram)
    rank = np.empty(len(back), np.int64)
    rank[back] = np.arange(len(back))
    # From here on in the order of the bytes from the anchor on.
    n, anchor, start, base_of, rank = n[turn], anchor[turn], start[turn], base[turn], rank[turn]
    least = np.empty(int(n.sum()), np.int64)
    for offset in range(w - method.gram + 1):
        live = np.flatnonzero((anchor >= offset) & (anchor - n < offset))
        if not len(live):
            continue
        key = np.cumsum(before < offset)[rank[live]] * len(turn) + np.cumsum(on < w - offset)[live]
        order = np.argsort(key)
        head, kind = np.flatnonzero(np.diff(key[order], prepend=-1)), np.empty(len(order), np.int64)
        step = anchor[live] - offset
        kind[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
        least[base_of[live] + step] = np.minimum.reduceat((start[live] + step)[order], head)[kind]
    # Back to every segment: its own starts against the least of each of its windows.
    step = steps(windows)
    return least[np.repeat(base[same], windows) + step] < np.repeat(starts, windows) + step


def counts(own: Group, removed: np.ndarray) -> pa.Table:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of a group's rows."""
    n, gone, spans, kept = [], [], [], []
    for a, b in zip(own.ends[:-1].tolist(), own.ends[1:].tolist(), strict=True):
        mark = removed[a:b]
        n.append(b - a)
        gone.append(int(mark.sum()))
        spans.append(int(mark[0]) + int((mark[1:] > mark[:-1]).sum()) if b > a else 0)
        kept.append(sha256(own.codes[a:b][~mark].tobytes()).hexdigest())
    return pa.table({"doc_id": own.table["doc_id"], "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})


METHOD = Method(WINDOW, 24, 1, True, read, lead, earlier_starts, counts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """What remains of every document, as counts and a digest."""
    return deduplicate(id_and_text(docs), METHOD)


def drop_repeated(docs: DataFrame) -> DataFrame:
    """`docs` without repeated bytes. A character of which only a part would remain goes whole; n_chars follows."""
    rows = wrapped(docs)

    def rest(own: Group, removed: np.ndarray) -> pa.Table:
        texts = [own.codes[a:b][~removed[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(own.ends[:-1].tolist(), own.ends[1:].tolist(), strict=True)]
        return pa.table({"row": own.table["row"], "text": pa.array(texts, pa.string())})

    method = replace(METHOD, finish=rest, result=StructType([rows.schema["row"], StructField("text", StringType())]))
    return unwrapped(deduplicate(rows, method), docs.columns, text=F.col("text"), n_chars=F.length("text").cast("long"))
