"""Finding repeated windows of tokens exactly, with two exchanges between groups of documents and buckets.

Every window of W tokens has an anchor: its k-gram with the smallest hash, the leftmost of equals. Equal
windows have equal anchors at equal places, so all copies of a window can meet where their anchor goes.
Runs of windows with one anchor form a segment. Rows are dealt into groups by id and text:

1. each group announces the hashes of its anchors, with the number of distinct segments there, to buckets by hash; a bucket
   answers which anchors recur at all, and which are hot, that is, have over HOT distinct segments;
2. each group sends the distinct segments at recurring anchors, with their least place, to buckets that range-partition
   anchors by their leading tokens at splitters, sampled from all recurring anchors; a bucket compares whole
   windows with an engine and answers, for each window, whether it starts earlier elsewhere. Hot anchors (a line shorter than
   the window in ever other surroundings, the ends of a common passage) are split: their windows go one by one, as 128-bit
   digests with their least place, to as many further buckets as the digests are dealt to.

A hot passage costs one segment a group, however many documents hold it, and unique text is never sent. Equal windows
never straddle two buckets, since splitters part anchors and digests part windows; so no comparison across boundaries is left.
Rows of messages are (group, bucket) pairs, of which a group has at most as many as it has anchors.
The texts are shuffled once; both later uses read the same exchange.
Within a group equal segments are told by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.llm.common import NO_ID, stretches, trimmed

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 2**64))
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
INDEX = np.uint64(2**18 - 1)
BLOCK = 2**17
#: Distinct segments of an anchor from which on its windows are dealt one by one.
HOT = 2000
#: Windows, about, that are compared or marked at once; bounds the memory of a task, not what is compared.
TOGETHER = 2**18


@dataclass
class Segments:
    """Distinct segments of a bucket's message: token bytes, sizes, anchor offsets and first places."""

    data: np.ndarray
    tokens: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray
    place: np.ndarray


@dataclass(frozen=True)
class Method:
    """What distinguishes the two operators. `read` gives tokens and document ends of a group's texts."""

    window: int
    gram: int
    width: int  # bytes of a token as sent
    within: bool  # whether an earlier start in the same document counts
    read: Callable
    lead: Callable
    engine: Callable
    finish: Callable
    result: str | StructType
    group_chars: int = 4_000_000
    bucket_chars: int = 2_000_000
    hot: int = HOT
    sample: int = 512  # one anchor hash in so many is sampled for the splitters
    together: int = TOGETHER
    #: From what `read` gave third and places of tokens, names that tell the tokens apart; without it the tokens do so themselves.
    names: Callable | None = None


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all k-grams, by doubling."""
    part, size = codes.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    while True:
        if gram & size:
            piece = part[done : len(codes) - gram + 1 + done]
            out = piece.copy() if out is None else out[: len(piece)] * MULTIPLIER + piece
            done += size
        if 2 * size > gram:
            return mixed(out)
        part = mixed(part[:-size] * MULTIPLIER + part[size:]) if len(part) > size else part[:0]
        size *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    out = []
    for base in (MULTIPLIER, INVERSE):
        power = np.full(n, base, np.uint64)
        power[:1] = 1
        out.append(np.multiply.accumulate(power))
    return out[0], out[1]


def stretch_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Hashes of stretches of a block, from cumulated sums."""
    up, down = powers(BLOCK + 1024)
    terms = mixed((codes.astype(np.uint64) + np.uint64(1)) * salt) * up[: len(codes)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * salt)


def digests_of(part: np.ndarray, begin: np.ndarray, sizes: np.ndarray, offset: np.ndarray) -> list[np.ndarray]:
    """Two digests of stretches of a block with the offset of their anchor."""
    return [mixed(stretch_hashes(part, begin, begin + sizes, salt) + offset * OTHER) for salt in (MULTIPLIER, OTHER)]


def runs(codes: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of a group in order: first window, number of windows, place and hash of the anchor, two digests of the tokens."""
    own = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
    out = []
    for at in range(0, len(codes) - window + 1, BLOCK):
        part = codes[at : at + BLOCK + window - 1]
        hashes = gram_hashes(part, gram)
        least = sliding_min((hashes & ~INDEX) | np.arange(len(hashes), dtype=np.uint64), window - gram + 1)
        place = (least & INDEX).astype(np.int64)
        start = np.flatnonzero(own[at : at + len(place)] == own[at + window - 1 : at + window - 1 + len(place)])
        if not len(start):
            continue
        place = place[start]
        cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(start) != 1)) + 1
        first = np.concatenate([[0], cut])
        n = np.diff(np.append(first, len(start)))
        begin, anchor = start[first], place[first]
        offset = (anchor - begin).astype(np.uint64)
        out.append((begin + at, n, anchor + at, hashes[anchor], *digests_of(part, begin, n + window - 1, offset)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def parted(numbers: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(number, where it stands) of each distinct number; places in ascending order."""
    order = np.argsort(numbers, kind="stable")
    cut = np.flatnonzero(np.diff(numbers[order])) + 1
    return [(int(numbers[x[0]]), x) for x in np.split(order, cut)] if len(order) else []


def steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, in a row."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def heads(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items in an order that puts equal keys together: the first of each kind, and the kind of each item."""
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(fresh) - 1
    return order[fresh], kind


def in_turn(places: np.ndarray, sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """`places` in stretches of about `most` in all of what they have of `sizes`."""
    cut = np.flatnonzero(np.diff(np.cumsum(sizes[places]) // most)) + 1
    return np.split(places, cut)


def by_anchor(segments: Segments, method: Method) -> np.ndarray:
    """For each window of each segment what the method's engine says, from segments of some anchors at a time.

    Equal windows have equal anchors, so windows of different parts are never equal.
    """
    sizes = segments.tokens.astype(np.int64)
    windows, begin = sizes - method.window + 1, np.cumsum(sizes) - sizes
    if windows.sum() <= method.together:
        return method.engine(segments, method)
    hashes = np.zeros(len(sizes), np.uint64)
    for k in range(method.gram):
        for byte in segments.data[begin + segments.anchor + k].T:
            hashes = hashes * MULTIPLIER + byte + np.uint64(1)
    hashes = mixed(hashes)
    order = np.argsort(hashes, kind="stable")
    first, kind = heads(order, hashes)
    before = np.empty(len(order), np.int64)
    before[order] = np.cumsum(windows[order]) - windows[order]
    out, base = np.zeros(int(windows.sum()), bool), np.cumsum(windows) - windows
    for _, part in parted((before[first] // method.together)[kind]):
        own = segments.data[np.repeat(begin[part], sizes[part]) + steps(sizes[part])]
        some = Segments(own, segments.tokens[part], segments.anchor[part], segments.doc[part], segments.place[part])
        out[np.repeat(base[part], windows[part]) + steps(windows[part])] = method.engine(some, method)
    return out


class Group:
    """The anchors of one group of documents; the same on every call for the same rows."""

    def __init__(self, table: pa.Table, method: Method):
        ids = np.array([NO_ID if x is None else x for x in table["doc_id"].to_pylist()], np.int64)
        texts = table["text"].to_pylist()
        order = sorted(range(table.num_rows), key=lambda i: (ids[i], texts[i]))
        self.table = table.take(pa.array(order, pa.int64()))
        self.ids = ids[order]
        self.method = method
        self.codes, self.ends, self.extra = method.read(self.table["text"].combine_chunks())
        self.tokens = self.codes
        self.start, self.windows, self.place, self.hash, d1, d2 = runs(self.codes, self.ends, method.window, method.gram)
        self.doc = np.searchsorted(self.ends, self.start, side="right") - 1
        self.id, self.at = self.ids[self.doc], self.start - self.ends[self.doc]
        self.stand(d1, d2)
        self.distinct, self.which = np.unique(self.hash, return_inverse=True)
        self.kinds = np.bincount(self.which[self.firsts], minlength=len(self.distinct))
        self.twice = np.bincount(self.which, minlength=len(self.distinct)) > 1

    def stand(self, d1: np.ndarray, d2: np.ndarray) -> None:
        """Of equal segments the one with the least document and place stands for all."""
        self.firsts, kind = heads(np.lexsort((self.at, self.id, d2, d1)), d1, d2)
        self.first = self.firsts[kind]
        self.firsts = np.sort(self.firsts)

    def named(self, shared: np.ndarray) -> None:
        """From now on tokens of segments at shared anchors are told by their names."""
        if self.method.names is None:
            return
        some, w = np.flatnonzero(shared[self.which]), self.method.window
        mark = np.zeros(len(self.codes) + 1, np.int32)
        np.add.at(mark, self.start[some], 1)
        np.add.at(mark, self.start[some] + self.windows[some] + w - 1, -1)
        places = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        self.tokens = np.zeros(len(self.codes), np.uint64)
        self.tokens[places] = self.method.names(self.extra, places)
        digests = np.zeros((2, len(self.start)), np.uint64)
        for block, mine in parted(self.start[some] // BLOCK):
            mine = some[mine]
            part = self.tokens[block * BLOCK : block * BLOCK + BLOCK + w - 1]
            digests[:, mine] = digests_of(part, self.start[mine] - block * BLOCK, self.windows[mine] + w - 1, (self.place - self.start)[mine].astype(np.uint64))
        # Others are not sent: each may stand for itself.
        rest = np.flatnonzero(~shared[self.which])
        digests[0, rest], digests[1, rest] = self.hash[rest], rest.astype(np.uint64)
        self.stand(*digests)

    def announced(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        return parted((self.distinct % np.uint64(buckets)).astype(np.int64))

    def answered(self, buckets: int, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Which distinct hashes recur, here or in another group, and which are hot."""
        shared, hot = self.twice.copy(), np.zeros(len(self.twice), bool)
        mine = dict(self.announced(buckets))
        for b, bits, more in zip(answers["b"].to_pylist(), answers["flags"].to_pylist(), answers["hot"].to_pylist(), strict=True):
            own = mine[b]
            shared[own] |= unpacked(bits, len(own))
            hot[own] = unpacked(more, len(own))
        self.named(shared)
        return shared, hot

    def windows_of(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digests of all windows of segments, in a row."""
        w = self.method.window
        sizes = self.windows[segments] + w - 1
        tokens = self.tokens[np.repeat(self.start[segments], sizes) + steps(sizes)]
        inside = np.repeat(np.cumsum(sizes) - sizes, self.windows[segments]) + steps(self.windows[segments])
        out = [np.zeros(len(inside), np.uint64) for _ in range(2)]
        for at in range(0, max(0, len(tokens) - w + 1), BLOCK):
            part = tokens[at : at + BLOCK + w - 1].astype(np.uint64)
            low, high = np.searchsorted(inside, [at, at + BLOCK])
            for k, salt in enumerate((MULTIPLIER, OTHER)):
                out[k][low:high] = gram_hashes(mixed((part + np.uint64(1)) * salt), w)[inside[low:high] - at]
        return out[0], out[1]


class Routes:
    """What a group sends: distinct segments by bucket, and distinct windows of hot anchors by bucket."""

    def __init__(self, own: Group, shared: np.ndarray, hot: np.ndarray, splitters: np.ndarray, buckets: int, hot_buckets: int):
        method, at = own.method, own.which[own.firsts]
        plain = own.firsts[shared[at] & ~hot[at]]
        keys = bucket_keys(method, own.codes, own.place[plain], own.hash[plain])
        self.plain = [(b, plain[x]) for b, x in parted(np.searchsorted(splitters, keys, side="right"))]
        self.hot_segments = own.firsts[hot[at]]
        n = own.windows[self.hot_segments]
        self.base = np.cumsum(n) - n
        d1, d2 = own.windows_of(self.hot_segments)
        ids = np.repeat(own.id[self.hot_segments], n)
        places = np.repeat(own.at[self.hot_segments], n) + steps(n)
        first, self.kind = heads(np.lexsort((places, ids, d2, d1)), d1, d2)
        self.digests, self.ids, self.places = np.stack([d1[first], d2[first]], axis=1), ids[first], places[first]
        self.hot = [(buckets + b, x) for b, x in parted((self.digests[:, 0] % np.uint64(hot_buckets)).astype(np.int64))]


def bucket_keys(method: Method, codes: np.ndarray, place: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Leading tokens of the suffix at an anchor, then its hash: parts a very common lead."""
    return (method.lead(codes, place).astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32))


def table_of(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


I32, BIN = pa.int32(), pa.binary()
SIGN = np.uint64(1 << 63)


def sampled_splitters(docs: DataFrame, method: Method, buckets: int, groups: int) -> np.ndarray:
    """Bounds of the buckets: quantiles of the keys of recurring anchors, of which all documents give one in `sample`.

    A distinct segment counts as often as groups send it, about. Only the quantiles reach the driver.
    """
    if buckets < 2:
        return np.zeros(0, np.uint64)

    def sampled(batches):
        for batch in batches:
            for at, n in stretches(batch.column("text")):
                codes, ends, _ = method.read(batch.column("text").slice(at, n))
                _, _, place, hashes, digest, _ = runs(codes, ends, method.window, method.gram)
                some = np.flatnonzero(hashes % np.uint64(method.sample) == 0)
                keys = bucket_keys(method, codes, place[some], hashes[some]) ^ SIGN
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (keys, hashes[some], digest[some])], ["key", "hash", "segment"])

    kinds = docs.select("text").mapInArrow(sampled, "key long, hash long, segment long").groupBy("hash", "key", "segment").agg(F.count("*").alias("n"))
    anchors = kinds.groupBy("hash").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).where((F.col("n") > 1) & (F.col("kinds") <= method.hot))
    bounds = [i / buckets for i in range(1, buckets)]
    sent = F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(groups).cast("long"))))
    found = kinds.join(anchors.select("hash"), "hash").select("key", sent).agg(F.percentile_approx("key", bounds, 100 * buckets)).first()[0]
    return np.unique(np.array(found or [], np.int64).view(np.uint64) ^ SIGN)


def deduplicate(docs: DataFrame, method: Method) -> DataFrame:
    """Apply `method` to rows (doc_id, text, ...): what its `finish` makes of each row and its removed tokens."""
    chars = docs.agg(F.sum(F.length("text")).alias("chars")).first()["chars"] or 0
    groups = max(1, -(-chars // method.group_chars))
    buckets = max(1, -(-chars // method.bucket_chars))
    hot_buckets = 4 * buckets
    splitters = sampled_splitters(docs, method, buckets, groups)
    by_group = docs.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))

    def announce(table: pa.Table) -> pa.Table:
        own, g = Group(table, method), table["g"][0].as_py()
        rows = own.announced(buckets)
        kinds = np.minimum(own.kinds, 65_535).astype(np.uint16)
        return table_of({"b": ([b for b, _ in rows], I32), "g": ([g] * len(rows), I32), "h": ([own.distinct[x].tobytes() for _, x in rows], BIN), "n": ([kinds[x].tobytes() for _, x in rows], BIN)})

    def compare(table: pa.Table) -> pa.Table:
        """Hashes that more than one group has, and those with many segments in all groups together."""
        parts = [np.frombuffer(x, np.uint64) for x in table["h"].to_pylist()]
        kinds = np.concatenate([np.frombuffer(x, np.uint16) for x in table["n"].to_pylist()])
        _, which, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared, hot = (count > 1)[which], (np.bincount(which, kinds) > method.hot)[which]
        ends = np.cumsum([0, *map(len, parts)])
        bits = [[packed(x[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)] for x in (shared, hot)]
        return pa.table({"g": table["g"], "b": table["b"], "flags": pa.array(bits[0], BIN), "hot": pa.array(bits[1], BIN)})

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("b", "g", "flags", "hot", "data", "tokens", "anchor", "doc", "place")
        out: dict[str, list] = {k: [] for k in names}

        def put(*row) -> None:
            # The first message of a group also carries what was answered, for `remove`.
            known = (packed(shared), packed(hot)) if not out["b"] else (None, None)
            for k, v in zip(names, (row[0], g, *known, *row[1:]), strict=True):
                out[k].append(v)

        if left.num_rows:
            own, g = Group(left, method), left["g"][0].as_py()
            shared, hot = own.answered(buckets, right)
            routes = Routes(own, shared, hot, splitters, buckets, hot_buckets)
            for b, mine in routes.plain:
                sizes = own.windows[mine] + method.window - 1
                tokens = own.tokens[np.repeat(own.start[mine], sizes) + steps(sizes)]
                data = np.ascontiguousarray(tokens.view(np.uint8).reshape(len(tokens), -1)[:, : method.width])
                put(b, data.tobytes(), sizes.astype(np.int32).tobytes(), (own.place - own.start)[mine].astype(np.int32).tobytes(), own.id[mine].tobytes(), own.at[mine].tobytes())
            for b, mine in routes.hot:
                put(b, routes.digests[mine].tobytes(), b"", b"", routes.ids[mine].tobytes(), routes.places[mine].tobytes())
        table = table_of({k: (v, I32 if k in "bg" else BIN) for k, v in out.items()})
        out.clear()
        trimmed()
        return table

    def judge(table: pa.Table) -> pa.Table:
        """For each window of each message, whether it starts earlier in the bucket than in its own group."""
        table = table.sort_by("g")
        read = lambda name, kind: [np.frombuffer(x, kind) for x in table[name].to_pylist()]
        docs_of, places = read("doc", np.int64), np.concatenate(read("place", np.int64))
        doc = np.concatenate(docs_of)
        if table["b"][0].as_py() < buckets:
            tokens = read("tokens", np.int32)
            all_of = Segments(np.concatenate(read("data", np.uint8)).reshape(-1, method.width), np.concatenate(tokens), np.concatenate(read("anchor", np.int32)), doc, places)
            earlier = by_anchor(all_of, method)
            counts = [int((t - method.window + 1).sum()) for t in tokens]
        else:
            d1, d2 = np.concatenate(read("data", np.uint64)).reshape(-1, 2).T
            first, kind = heads(np.lexsort((places, doc, d2, d1)), d1, d2)
            earlier = doc[first][kind] < doc
            if method.within:
                earlier |= (doc[first][kind] == doc) & (places[first][kind] < places)
            counts = list(map(len, docs_of))
        ends = np.cumsum([0, *counts])
        bits = [packed(earlier[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        answer = pa.table({"g": table["g"], "b": table["b"], "flags": table["flags"], "hot": table["hot"], "bits": pa.array(bits, BIN)})
        trimmed()
        return answer

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Group(left, method)
        repeated = np.zeros(len(own.codes), bool)  # where windows start that go

        def later(ids: np.ndarray, places: np.ndarray, first_ids: np.ndarray, first_places: np.ndarray) -> np.ndarray:
            return (ids > first_ids) | ((ids == first_ids) & (places > first_places) & method.within)

        if right.num_rows:
            answers = list(zip(right["b"].to_pylist(), right["bits"].to_pylist(), strict=True))
            shared, hot = (next(unpacked(x, len(own.distinct)) for x in right[k].to_pylist() if x is not None) for k in ("flags", "hot"))
            own.named(shared)
            routes, bits = Routes(own, shared, hot, splitters, buckets, hot_buckets), dict(answers)
            # Windows of plain segments: the answer to the segment that stands for them, or the place of that one.
            offset, found, base = np.zeros(len(own.start), np.int64), [np.zeros(0, bool)], 0
            for b, mine in routes.plain:
                n = own.windows[mine]
                offset[mine] = base + np.cumsum(n) - n
                found.append(unpacked(bits[b], int(n.sum())))
                base += int(n.sum())
            found = np.concatenate(found)
            for chosen in in_turn(np.flatnonzero((shared & ~hot)[own.which]), own.windows, method.together):
                head, n = own.first[chosen], own.windows[chosen]
                gone = found[np.repeat(offset[head], n) + steps(n)] | np.repeat(later(own.id[chosen], own.at[chosen], own.id[head], own.at[head]), n)
                repeated[(np.repeat(own.start[chosen], n) + steps(n))[gone]] = True
            # Windows at hot anchors: each by its own digest.
            found = np.zeros(len(routes.ids), bool)
            for b, mine in routes.hot:
                found[mine] = unpacked(bits[b], len(mine))
            offset[routes.hot_segments] = routes.base
            for chosen in in_turn(np.flatnonzero(hot[own.which]), own.windows, method.together):
                n = own.windows[chosen]
                kind = routes.kind[np.repeat(offset[own.first[chosen]], n) + steps(n)]
                gone = found[kind] | later(np.repeat(own.id[chosen], n), np.repeat(own.at[chosen], n) + steps(n), routes.ids[kind], routes.places[kind])
                repeated[(np.repeat(own.start[chosen], n) + steps(n))[gone]] = True
        # A token goes if one of the windows that start at it or up to a window before goes.
        so_far = np.cumsum(repeated, dtype=np.int32)
        so_far[method.window :] = so_far[method.window :] - so_far[: -method.window]
        rest = method.finish(own, so_far > 0)
        trimmed()
        return rest

    hashes = by_group.groupBy("g").applyInArrow(announce, "b int, g int, h binary, n binary")
    shared = hashes.groupBy("b").applyInArrow(compare, "g int, b int, flags binary, hot binary")
    sent = by_group.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(
        send, "b int, g int, flags binary, hot binary, data binary, tokens binary, anchor binary, doc binary, place binary"
    )
    judged = sent.groupBy("b").applyInArrow(judge, "g int, b int, flags binary, hot binary, bits binary")
    return by_group.groupBy("g").cogroup(judged.groupBy("g")).applyInArrow(remove, method.result)
