"""Substring dedup of word windows with a compressed FM-index per shard.

A shard is a bucket of anchored segments (see `anchors`): all copies of a 50-word window meet in one shard. The
shard's distinct segments are indexed: Burrows-Wheeler transform in a wavelet matrix of packed bits with a rank
count for every 128 bits, about 1.25 bits for each bit of a word's number, plus a least document for each distinct window;
the suffix order is dropped once the transform is made. The segments of the documents are then streamed through it by batched
backward search from their right ends. The statistic kept for a position is the length of the match there, up to the window; where
it reaches the window, the interval's smallest document decides whether the window is reported. As a shard's segments are all
in its index, each search there succeeds; a pattern that is in no index starts anew one word to the left.

Anchors come from plain hashes of words, which only decide what meets; words of segments that recur are told apart by 64 bits of their BLAKE2 digest: two windows are mixed up only if they differ in nothing but words whose
digests meet, at a chance of 5e-20 for a pair of words. Texts cannot bring that about but by some 2^32 digests made to find such words. Null and empty texts have no word. A window counts as repeated if it also starts in a
document with a smaller id; null ids come last. Repeats within one document, or between rows that repeat an id, stay.
Very long texts are taken whole, in one group. An empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.anchors import MULTIPLIER, OTHER, Group, Method, Segments, deduplicate, mixed
from weftline.llm.common import id_and_text, utf8

WINDOW = 50
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[32, 9, 10, 11, 12, 13]] = True
CHUNK = 2**19


class Numbers(dict):
    """The number of each word: 64 bits of its BLAKE2 digest, made once for each distinct word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return number


def boundaries(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, their ends, and where words begin and end in the bytes."""
    data, ends = utf8(texts)
    apart = SEPARATORS[data]
    start = ~apart
    start[1:] &= apart[:-1]
    fresh = ends[:-1][np.diff(ends) > 0]
    start[fresh] = ~apart[fresh]
    stop = ~apart
    stop[:-1] &= apart[1:]
    last = ends[1:][np.diff(ends) > 0] - 1
    stop[last] = ~apart[last]
    return data, ends, np.flatnonzero(start), np.flatnonzero(stop) + 1


def read(texts: pa.Array):
    """Numbers of all words, ends of documents in words, and where each word is in the bytes."""
    data, ends, first, after = boundaries(texts)
    return numbers((data, first, after), np.arange(len(first)), np.searchsorted(first, ends)), np.searchsorted(first, ends), (data, first, after)


def numbers(words: tuple[np.ndarray, np.ndarray, np.ndarray], places: np.ndarray, stops: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the words at `places`; with `stops`, the ends of documents, of all words."""
    data, first, after = words
    number, whole, out = Numbers(), data.tobytes(), np.zeros(len(places), np.uint64)
    if stops is None:
        found = map(whole.__getitem__, map(slice, first[places].tolist(), after[places].tolist()))
        return np.fromiter(map(number.__getitem__, found), np.uint64, len(places))
    for low, high in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
        while low < high:  # words of about CHUNK bytes of one document at a time
            end = min(high, max(low + 1, int(np.searchsorted(after, first[low] + CHUNK, side="right"))))
            out[low:end] = np.fromiter(map(number.__getitem__, whole[first[low] : after[end - 1]].split()), np.uint64, end - low)
            low = end
    return out


def sketch(texts: pa.Array):
    """As `read`, but with hashes that only find candidates: sums over bytes, each mixed with its place in the word."""
    data, ends, first, after = boundaries(texts)
    codes, at = np.zeros(len(first), np.uint64), 0
    while at < len(first):  # words of one stretch of bytes at a time
        end = max(at + 1, int(np.searchsorted(after, first[at] + CHUNK, side="right")))
        sizes = after[at:end] - first[at:end]
        if sizes[0] > CHUNK:  # a word that is longer stands alone
            codes[at] = Numbers()[data[first[at] : after[at]].tobytes()]
            at = end
            continue
        begin = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
        terms = mixed((data[np.repeat(first[at:end], sizes) + place].astype(np.uint64) + np.uint64(1)) * MULTIPLIER + place.astype(np.uint64) * OTHER)
        codes[at:end] = mixed(np.add.reduceat(terms, begin) + sizes.astype(np.uint64) * MULTIPLIER)
        at = end
    return codes, np.searchsorted(first, ends), (data, first, after)


def lead(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    return codes[place] >> np.uint64(32)


class FMIndex:
    """Index of a text of small numbers, where 0 parts the segments, for windows of a fixed size.

    `docs` has a document for each place of the text; the least one is kept for each distinct window.
    """

    def __init__(self, text: np.ndarray, docs: np.ndarray, window: int):
        n, half = len(text), 1
        rank = text.astype(np.int64)
        half_rank, reach = rank, 1
        while True:
            behind = np.full(n, -1, np.int64)
            behind[: n - half] = rank[half:]
            key = rank * (int(behind.max(initial=0)) + 2) + behind + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            half *= 2
            if half < window:
                half_rank, reach = rank, half
            if half >= window or rank.max(initial=0) == n - 1:
                break
        shorter, whole = (fresh(order, half_rank, reach, size) for size in (window - 1, window))
        # Of suffixes in order: intervals that agree in all words of a window but its last, and the windows.
        self.left = np.flatnonzero(shorter).astype(np.int32)
        self.right = np.append(self.left[1:], n).astype(np.int32)
        self.group = (np.cumsum(shorter) - 1).astype(np.int32)
        self.number = (np.cumsum(whole) - 1).astype(np.int32)
        self.least = np.minimum.reduceat(docs[order], np.flatnonzero(whole))
        self.size = n
        self.levels = max(1, int(text.max(initial=1)).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now, symbols = text[order - 1], np.arange(int(text.max(initial=0)) + 1)
        del order, rank, half_rank
        first = np.zeros(len(symbols), np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(np.uint8)
            words = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 128 + 128, np.uint8)]), bitorder="little").view(np.uint64)
            self.words.append(words)
            pairs = np.bitwise_count(words).reshape(-1, 2).sum(axis=1, dtype=np.uint32)
            self.counts.append(np.concatenate([[0], np.cumsum(pairs)]).astype(np.uint32))
            self.zeros.append(int(len(bit) - bit.sum()))
            first = self.step(len(self.words) - 1, symbols >> level & 1, first)
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        sizes = np.bincount(text, minlength=len(symbols))
        self.shift = np.cumsum(sizes) - sizes - first  # of a symbol's block against its place in the last level

    def step(self, level: int, bit: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where positions go in the next level of the wavelet matrix, for the given bits."""
        word, words = at >> 6, self.words[level]
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        ones = self.counts[level][at >> 7].astype(np.int64) + np.bitwise_count(words[word] & mask)
        ones += np.where(word & 1, np.bitwise_count(words[word - 1]), 0)
        return np.where(bit == 1, self.zeros[level] + ones, at - ones)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        both, twice = np.concatenate([low, high]), np.concatenate([symbol, symbol])
        for k in range(self.levels):
            both = self.step(k, twice >> (self.levels - 1 - k) & 1, both)
        both += self.shift[twice]
        return both[: len(low)], both[len(low) :]


def fresh(order: np.ndarray, half_rank: np.ndarray, half: int, size: int) -> np.ndarray:
    """Marks of the suffixes, in order, that differ from the one before within `size` symbols (half < size <= 2 half)."""
    a, b, end, ahead = order[1:], order[:-1], len(half_rank) - 1, size - half
    equal = (half_rank[a] == half_rank[b]) & (half_rank[np.minimum(a + ahead, end)] == half_rank[np.minimum(b + ahead, end)])
    return np.concatenate([[True], ~equal])


def least_documents(index: FMIndex, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """For every window of every streamed segment the least document where it occurs in the index, or the largest number."""
    windows = sizes - window + 1
    base = np.cumsum(windows) - windows
    out = np.full(int(windows.sum()), np.iinfo(np.int64).max)
    live = np.arange(len(starts))
    start = windows - 1  # of the window sought
    have = np.zeros(len(starts), np.int64)
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), index.size)
    while len(live):
        symbol = text[starts[live] + start[live] + window - have[live] - 1]
        known = symbol < len(index.shift)
        lo, hi = index.extend(np.where(known, symbol, 0), low[live], high[live])
        found = known & (hi > lo)
        have[live] += 1
        full = found & (have[live] == window)
        hit = live[full]
        out[base[hit] + start[hit]] = index.least[index.number[lo[full]]]
        # A whole match gives up its last word and goes on one word to the left; a failed one starts anew there.
        g = index.group[lo[full]]
        lo[full], hi[full] = index.left[g], index.right[g]
        have[hit] = window - 1
        start[hit] -= 1
        failed = live[~found]
        lo[~found], hi[~found] = 0, index.size
        have[failed] = 0
        start[failed] -= 1
        low[live], high[live] = lo, hi
        live = live[start[live] >= 0]
    return out


def earlier_documents(segments: Segments, method: Method) -> np.ndarray:
    """For every window of every segment, whether it also starts in a document with a smaller id."""
    window, sizes = method.window, segments.tokens.astype(np.int64)
    _, symbols = np.unique(np.ascontiguousarray(segments.data).view(np.uint64).reshape(-1), return_inverse=True)
    symbols = symbols.reshape(-1) + 1
    ends = np.cumsum(sizes) - sizes
    raw, seen = symbols.astype(np.int32).tobytes(), {}
    same = np.array([seen.setdefault(raw[4 * s : 4 * (s + n)], len(seen)) for s, n in zip(ends.tolist(), sizes.tolist(), strict=True)], np.int64)
    order = np.lexsort((segments.doc, same))
    first = order[np.flatnonzero(np.diff(same[order], prepend=-1))]
    n = sizes[first]
    at = np.cumsum(n + 1) - n - 1
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    text = np.zeros(int(n.sum()) + len(n), np.int64)
    text[np.repeat(at, n) + step] = symbols[np.repeat(ends[first], n) + step]
    least = least_documents(FMIndex(text, np.repeat(segments.doc[first], n + 1), window), text, at, n, window)
    windows = sizes - window + 1
    base = np.cumsum(n - window + 1) - (n - window + 1)
    step = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    return least[np.repeat(base[same], windows) + step] < np.repeat(segments.doc, windows)


def counts(own: Group, removed: np.ndarray) -> pa.Table:
    """(doc_id, n_words, n_removed, kept_sha256) of a group's rows."""
    data, first, after = own.extra
    n, gone, kept = [], [], []
    for a, b in zip(own.ends[:-1].tolist(), own.ends[1:].tolist(), strict=True):
        mark = removed[a:b]
        n.append(b - a)
        gone.append(int(mark.sum()))
        stay = np.flatnonzero(~mark) + a
        low = int(first[a]) if b > a else 0
        raw = data[low : int(after[b - 1])].tobytes() if b > a else b""
        words = [raw[s:e] for s, e in zip((first[stay] - low).tolist(), (after[stay] - low).tolist(), strict=True)]
        kept.append(sha256(b" ".join(words)).hexdigest())
    return pa.table({"doc_id": own.table["doc_id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})


METHOD = Method(WINDOW, 8, 8, False, sketch, lead, earlier_documents, counts, "doc_id long, n_words long, n_removed long, kept_sha256 string", bucket_chars=6_000_000, names=numbers)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """What remains of every document without repeated windows, as counts and a digest."""
    return deduplicate(id_and_text(docs), METHOD)
