"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text is turned into a few counts and ratios, the trees are grown in numpy on a bounded sample of
labelled rows, and the forest is flattened into arrays so that a batch walks all trees at once.
Null and empty texts have all-zero statistics and get the forest's score for those; without any labelled
row every score is 0.5. Very long texts are measured whole, a few MB of texts at a time. Repeated rows, also of one id,
are scored alike; an empty table has no scores. Other columns, whatever their names, are ignored by `score` and kept
by `keep_good`. Equal gains go to the first statistic and the lowest limit.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import by_text, crc_of_id, id_and_text, labelled_sample, stretches, unwrapped, utf8, wrapped

#: Byte classes: lower-case ASCII, upper-case ASCII, digit, blank, newline, sentence mark, bar, other ASCII, non-ASCII.
CLASSES = 9
BYTE_CLASS = np.full(256, 7, np.uint8)
BYTE_CLASS[ord("a") : ord("z") + 1] = 0
BYTE_CLASS[ord("A") : ord("Z") + 1] = 1
BYTE_CLASS[ord("0") : ord("9") + 1] = 2
BYTE_CLASS[[9, 32]] = 3
BYTE_CLASS[[10, 13]] = 4
BYTE_CLASS[[ord(c) for c in ".,;:?'"]] = 5
BYTE_CLASS[ord("|")] = 6
BYTE_CLASS[128:] = 8


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics for each whole text."""
    data, ends = utf8(texts)
    size = np.diff(ends)
    by_class = np.zeros((len(size), CLASSES))
    full = np.flatnonzero(size)
    if len(full):
        kinds = BYTE_CLASS[data]
        for k in range(CLASSES):
            by_class[full, k] = np.add.reduceat(kinds == k, ends[:-1][full], dtype=np.int64)
    shape = np.zeros((len(size), 9))
    for i, text in enumerate(texts.to_pylist()):
        words = text.split()
        n = len(words)
        if n:
            lines = text.split("\n")
            counts = Counter(words)
            shape[i] = (
                np.log1p(n),
                len(text) / n,
                len(counts) / n,
                max(counts.values()) / n,
                sum(map(eq, words, words[1:])) / n,
                len(set(lines)) / len(lines),
                n / len(lines),
                sum(v for v in counts.values() if v > 1) / n,
                sum(map(len, counts)) / len(counts),
            )
    return np.hstack([by_class / np.maximum(size, 1)[:, None], shape])


class Forest:
    """Complete binary trees in arrays: inner nodes in breadth-first order, then leaves."""

    def __init__(self, base: float, feature: np.ndarray, limit: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.limit, self.leaf = base, feature, limit, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        inner = self.feature.shape[1]
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.limit[trees, node])
        raw = self.base + self.leaf[trees, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, bins: int = 64, rate: float = 0.2) -> Forest:
    """Boost `trees` trees on logistic loss; splits are sought on histograms of at most `bins` quantile bins."""
    inner = 2**depth - 1
    feature, limit, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if not len(y):
        return Forest(0.0, feature[:1], limit[:1], leaf[:1])
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            at_node = node - first
            for f in range(x.shape[1]):
                cell = at_node * bins + binned[:, f]
                g = np.bincount(cell, grad, width * bins).reshape(width, bins)
                h = np.bincount(cell, hess, width * bins).reshape(width, bins)
                left_g, left_h = g.cumsum(1), h.cumsum(1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
                gain[(left_h < 1) | (all_h - left_h < 1)] = 0
                gain = gain[:, : len(edges[f])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                feature[t, first : first + width][better] = f
                limit[t, first : first + width][better] = edges[f][at[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[t, node]] > limit[t, node])
        slot = node - inner
        leaf[t] = -rate * np.bincount(slot, grad, inner + 1) / (np.bincount(slot, hess, inner + 1) + 1)
        raw += leaf[t][slot]
    return Forest(base, feature, limit, leaf)


def fit(docs: DataFrame, labels: DataFrame, eligible, label: str = "quality", per_class: int = 6000, **options) -> Forest:
    """Train on at most `per_class` labelled documents of each label (a documented bound).

    Only the statistics of these documents reach the driver. Rows are weighted so that the labels'
    shares are those of all eligible labelled rows.
    """
    sample = labelled_sample(labels, label, eligible, per_class)
    share = labels.where(F.col(label).isin(0, 1) & eligible).groupBy(F.col(label).alias("y")).count().toPandas()
    chosen = id_and_text(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")

    def measure(batches):
        for batch in batches:
            for at, n in stretches(batch.column("text")):
                part = batch.slice(at, n)
                x = pa.array(list(statistics(part.column("text"))), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), x], ["doc_id", "y", "x"])

    # One row of statistics for each id, however many rows repeat it.
    seen = chosen.mapInArrow(measure, "doc_id long, y int, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id", kind="stable")
    y = seen["y"].to_numpy(np.float64)
    x = np.stack(seen["x"].to_list()) if len(seen) else np.zeros((0, CLASSES + 9))
    counts = dict(zip(share["y"], share["count"], strict=True))
    weight = np.ones(len(y))
    for k in (0, 1):
        mine = y == k
        weight[mine] = counts.get(k, 0) / max(mine.sum(), 1)
    return grow(x, y, weight / max(weight.mean(), 1e-9) if len(y) else weight, **options)


def scored(forest: Forest):
    """The score of a column of texts."""
    return by_text(F.col("text"), "double", lambda: lambda texts: forest.score(statistics(texts)))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score) of every row of `docs`."""
    return id_and_text(docs).select("doc_id", scored(forest).alias("score"))


#: A document is kept as good from this score on.
THRESHOLD = 0.3


def learns_from(column: str = "doc_id"):
    """Rows whose labels may be learnt: those not held out."""
    return crc_of_id(column) % 5 != 0


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; labels of held-out rows are not read."""
    forest = fit(docs, labels, learns_from())
    return score(docs, forest).select(
        "doc_id", (~learns_from()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` whose quality score reaches the threshold, with their columns as they were."""
    forest = fit(docs, labels, learns_from())
    return unwrapped(wrapped(docs).where(scored(forest) >= THRESHOLD), docs.columns)
