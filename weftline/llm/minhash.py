"""MinHash near-dedup with DartMinHash signatures.

A document is a weighted set of its shingles of five words. Every shingle throws hashed darts at a plane of weight
and rank, cell by cell, the same for all documents; a document sees the darts below its shingles' weights up
to a rank at which, on average, each of the signature's coordinates is hit a few times. The earliest dart of
each coordinate is kept, so two signatures agree in a coordinate with the probability of their weighted
Jaccard similarity. With weight 1 for each shingle, as in the registered query, that is the plain one.

Documents with equal shingle sets are one node. Bands of coordinates are joined: in each bucket nodes are compared
with pivots, and a candidate pair becomes a link if the exact similarity of the shingle sets reaches the
threshold. The first pivot is the least node. Buckets whose nodes are not yet in one component get more pivots, chosen by hash
and 32 times as many in each round, until every pair there is compared or implied; nothing is capped or ordered as a whole. From the second round on, a pair becomes a candidate
only if the parities of its sets allow the threshold: shingles are dealt into cells, and the cells in which
one set has an odd number and the other an even one are at most the shingles that only one of them has. That bound
is exact, so no link is lost, and near copies that stay apart from a large group are ruled out inside the join.
Classes are connected components.

Texts of one to four words have one shingle, all their words. Texts without words (null and empty ones) are in no
group. Repeated rows are one class, and so are rows that repeat an id where their texts are near. Very long texts are taken whole.
An empty table has no classes. Other columns, whatever their names, are ignored by `classes` and kept by `keep_one`.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.anchors import MULTIPLIER, mixed
from weftline.llm.common import NO_ID, discard, id_and_text, materialize, trimmed, unwrapped, wrapped
from weftline.llm.components import components
from weftline.llm.fmindex import read

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
#: Cells for parities, in words of 64 bits.
PARITY = 32
#: Pivots of a bucket are up to powers of this.
PIVOTS = 32
#: Ranks up to 1/4 are one cell; further cells double.
FIRST_RANK = 0.25


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, how often each occurs, and the texts' ends."""
    codes, ends, _ = read(texts)
    sets, counts = [], []
    h = np.zeros(max(0, len(codes) - words + 1), np.uint64)
    for k in range(words):
        h = mixed(h * MULTIPLIER + codes[k : k + len(h)] + np.uint64(1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        own = h[a : b - words + 1]
        if b - a < words:
            own = np.frombuffer(blake2b(codes[a:b].tobytes(), digest_size=8).digest(), np.uint64)[: b > a]
        found, n = np.unique(own, return_counts=True)
        sets.append(found)
        counts.append(n)
    sizes = np.cumsum([0, *map(len, sets)])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *sets]), np.concatenate([np.zeros(0, np.int64), *counts]), sizes


@lru_cache(maxsize=64)
def poisson(mean: float) -> np.ndarray:
    """Cumulated Poisson probabilities."""
    n = np.arange(int(mean + 12 * np.sqrt(mean) + 20))
    logs = n * np.log(mean) - mean - np.concatenate([[0], np.cumsum(np.log(n[1:]))])
    return np.minimum(np.cumsum(np.exp(logs)), 1)


def uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def cells(limit: float, first: float):
    """(number, low, width) of cells that start below `limit`."""
    low, width, k = 0.0, first, 0
    while low < limit:
        yield k, low, width
        low, k = low + width, k + 1
        width = low


def darts(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """For each set the rank of the earliest dart of every coordinate; infinite for empty sets."""
    n = len(sizes) - 1
    best = np.full((n, coordinates), np.inf)
    owner = np.repeat(np.arange(n), np.diff(sizes))
    total = np.bincount(owner, weights, n)
    hits = coordinates * (np.log(coordinates) + 3.0)
    todo = np.flatnonzero(np.diff(sizes))
    while len(todo):
        reach = np.zeros(n)
        reach[todo] = hits / total[todo]
        best[todo] = np.inf
        mine = np.flatnonzero(reach[owner] > 0)
        for r, rank_low, rank_width in cells(reach.max(), FIRST_RANK):
            sees = mine[reach[owner[mine]] > rank_low]
            for a, weight_low, weight_width in cells(weights[sees].max(initial=0), 1.0):
                some = sees[weights[sees] > weight_low]
                cell = mixed(elements[some] ^ (np.array([64 * r + a + 1], np.uint64) * MULTIPLIER))
                number = np.searchsorted(poisson(rank_width * weight_width), uniform(cell), side="right")
                thrown = np.repeat(np.arange(len(some)), number)
                turn = np.arange(len(thrown)) - np.repeat(np.cumsum(number) - number, number)
                dart = mixed(cell[thrown] + (turn.astype(np.uint64) + np.uint64(1)) * MULTIPLIER)
                rank = rank_low + rank_width * uniform(dart)
                dart = mixed(dart)
                element = some[thrown]
                inside = rank < reach[owner[element]]
                if weight_low + weight_width > 1 or weights[some].min(initial=1) < 1:
                    inside &= weight_low + weight_width * uniform(mixed(dart)) < weights[element]
                dart, rank, element = dart[inside], rank[inside], element[inside]
                np.minimum.at(best.reshape(-1), owner[element] * coordinates + (dart % np.uint64(coordinates)).astype(np.int64), rank)
        todo = todo[np.isinf(best[todo]).any(axis=1)]  # throw farther until every coordinate is hit
        hits *= 2
    return best


def band_hashes(ranks: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = ranks.view(np.uint64).reshape(len(ranks), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for k in range(rows):
        h = mixed(h * MULTIPLIER + bits[:, :, k])
    return h.view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, by_count: bool = False) -> DataFrame:
    """(doc_id, content, key, bands): with `content` as it is, a digest of the shingle set and the band hashes; nulls for texts without words."""

    def sign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets, counts, sizes = shingles(part.column("text"))
                weights = counts.astype(np.float64) if by_count else np.ones(len(sets))
                found = band_hashes(darts(sets, weights, sizes, bands * rows), bands, rows)
                full = np.diff(sizes) > 0
                raw = sets.tobytes() + (counts.astype(np.uint64).tobytes() if by_count else b"")
                shift = 8 * len(sets)
                keys = [blake2b(raw[8 * a : 8 * b] + (raw[shift + 8 * a : shift + 8 * b] if by_count else b""), digest_size=16).digest() if b > a else None for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]
                lists = [x if ok else None for x, ok in zip(list(found), full.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("content"), pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "content", "key", "bands"])
        trimmed()

    return docs.mapInArrow(sign, "doc_id long, content binary, key binary, bands array<long>")


def parities(shingles_of: np.ndarray) -> np.ndarray:
    """One bit for each cell: whether an odd number of shingles falls there."""
    odd = np.bincount((shingles_of & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sets_of(docs: DataFrame) -> DataFrame:
    """(node, set, size, odd): the sorted 64-bit shingle hashes of each row as bytes, their number and parities."""

    def collect(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets, _, sizes = shingles(part.column("text"))
                own = [sets[a:b] for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]
                columns = [pa.array([x.tobytes() for x in own], pa.binary()), pa.array(np.diff(sizes)), pa.array([parities(x) for x in own], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["node", "set", "size", "odd"])
        trimmed()

    return docs.mapInArrow(collect, "node long, set binary, size long, odd array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets have at least this Jaccard similarity."""

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similar * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    other = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long")


def may_link(similar: float) -> Column:
    """Whether sizes and parities of a pair allow the threshold: bounds on the shingles that only one has."""
    apart = (F.col("size") + F.col("size_a")) * ((1 - similar) / (1 + similar)) + 1e-6
    odd = sum(F.bit_count(F.get("odd", F.lit(i)).bitwiseXOR(F.get("odd_a", F.lit(i)))) for i in range(PARITY))
    return (F.abs(F.col("size") - F.col("size_a")) <= apart) & (odd <= apart)


def near_links(sets: DataFrame, members: DataFrame, similar: float) -> DataFrame | None:
    """(node, label) of all nodes that have a link; None without any."""
    links, labels, turn = None, None, 0
    while True:
        if labels is None:
            placed = members.withColumn("label", F.col("node"))
        else:
            placed = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        by_bucket = placed.groupBy("bucket").agg(F.min(F.struct("node", "label")).alias("m"), F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n"))
        # A bucket is open while its nodes are in several components and not all have been pivots.
        still = (F.col("x") < F.col("y")) & ((F.col("n") > PIVOTS ** (turn - 1)) if turn else F.lit(True))
        open_ = materialize(by_bucket.where(still).select("bucket", "n", F.col("m.node").alias("a"), F.col("m.label").alias("label_a")), "open-buckets")
        if open_.isEmpty():
            discard(open_)
            return labels
        if not turn:  # the least node of a bucket is its first pivot
            pairs = placed.join(open_, "bucket").where((F.col("a") < F.col("node")) & (F.col("label") != F.col("label_a"))).select("a", F.col("node").alias("b"))
        else:
            # A node's number in its bucket is about uniform below the bucket's size; those below PIVOTS ** turn are pivots now.
            number = F.pmod(F.xxhash64("node", "bucket"), F.lit(1 << 40)) / float(1 << 40) * F.col("n")
            rows = placed.join(open_.select("bucket", "n"), "bucket").join(sets.select("node", "size", "odd"), "node").withColumn("number", number)
            now = (F.col("number") < PIVOTS**turn) & (F.col("number") >= (PIVOTS ** (turn - 1) if turn > 1 else 0))
            chosen = rows.where(now).select("bucket", F.col("node").alias("a"), F.col("label").alias("label_a"), F.col("size").alias("size_a"), F.col("odd").alias("odd_a"))
            wanted = (F.col("a") != F.col("node")) & (F.col("label") != F.col("label_a")) & may_link(similar)
            pairs = rows.join(chosen, "bucket").where(wanted).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        pairs = materialize(pairs.distinct(), "near-pairs")
        found = materialize(verified(pairs, sets, similar), "near-links")
        discard(open_, pairs)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links)
        turn += 1


def content() -> Column:
    """What a row is known by besides its id: rows that repeat an id may hold different texts."""
    return F.unhex(F.sha2("text", 256))


def classed_rows(docs: DataFrame, similar: float) -> DataFrame:
    """(doc_id, content, class_id, kept) of every row."""
    docs = id_and_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    signed = materialize(signatures(docs.withColumn("content", content())), "signatures")
    nodes = materialize(
        signed.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct("doc_id", "bands")).alias("m")).select("key", F.col("m.doc_id").alias("node"), "m.bands"),
        "nodes",
    )
    buckets = nodes.select(F.explode("bands").alias("bucket"), "node")
    shared = buckets.groupBy("bucket").agg((F.min("node") < F.max("node")).alias("several")).where("several").select("bucket")
    members = materialize(buckets.join(shared, "bucket").distinct(), "members")
    wanted = members.select("node").distinct()
    sets = materialize(sets_of(docs.join(wanted, docs["doc_id"] == wanted["node"], "left_semi")).dropDuplicates(["node", "set"]), "sets")
    labels = near_links(sets, members, similar)
    classed = nodes.select("key", "node")
    if labels is None:
        classed = classed.withColumn("label", F.col("node"))
    else:
        classed = classed.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    out = signed.select("doc_id", "content", "key").join(classed.select("key", "label"), "key", "left")
    own = F.coalesce("label", "doc_id")
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "content", F.nullif(own, F.lit(NO_ID)).alias("class_id"), (F.col("doc_id") == own).alias("kept"))


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id, kept): the smallest id of each document's class, and whether it is that document."""
    return classed_rows(docs, similar).select("doc_id", "class_id", "kept")


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of `docs` that stay: of each class those with its smallest id. Rows without an id stay.

    Rows are told by id and text, so a row that repeats an id with another text stays or goes by its own class.
    """
    gone = classed_rows(docs, similar).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("gone"), F.col("content").alias("as"))
    rows = wrapped(docs)
    return unwrapped(rows.join(gone.distinct(), (rows["doc_id"] == F.col("gone")) & (content() == F.col("as")), "left_anti"), docs.columns)
