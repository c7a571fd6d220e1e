"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of embeddings hashed from the whole word and from its first letters. Filters
of several widths run over the word vectors of a whole text, the largest response of each is kept, and a
logistic unit scores them. The language, guessed from function words of the text itself, selects a
calibrated threshold, which is then mapped to the common cut of 0.7.
Null and empty texts have no word; their pooled responses are 0. Without labelled rows every score is 0.
Very long texts are scored whole. Repeated rows, also of one id, are scored alike; an empty table has no scores; other
columns, whatever their names, are ignored. Of languages with equally many function words the first by name counts.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import by_text, crc_of_id, id_and_text, labelled_sample

THRESHOLD = 0.7
BUCKETS, WIDTH, FILTERS, SPANS = 2**17, 8, 8, (1, 2, 3)
STEPS = 750
WORD = re.compile(r"[^\W_]+")

#: Frequent function words by language.
FUNCTION_WORDS = {
    "de": "der die und das von den mit nicht sich ist auf für ein eine dem zu",
    "en": "the of and to in is that for it with was on are be this by",
    "es": "el los del las que una por con para su como más y es lo se",
    "fr": "le les des une est du dans qui pour par sur au avec et il ce",
}
LANGUAGES = sorted(FUNCTION_WORDS)
LANGUAGE_OF = {w: LANGUAGES.index(k) for k, words in FUNCTION_WORDS.items() for w in words.split()}


def hashed(word: str) -> tuple[int, int, int, int]:
    """Embedding rows of a lower-case word: itself and its first 4, 5 and 6 letters."""
    return (
        crc32(word.encode()) % BUCKETS,
        crc32(b"4" + word[:4].encode()) % BUCKETS,
        crc32(b"5" + word[:5].encode()) % BUCKETS,
        crc32(b"6" + word[:6].encode()) % BUCKETS,
    )


class Words:
    """Words of texts as rows of a table of embedding rows; row 0 is the padding behind a text."""

    def __init__(self, most: int = 150_000):
        self.most = most
        self.clear()

    def clear(self):
        self.row, self.table, self.filled = {}, np.zeros((1024, 4), np.int32), 1

    def add(self, words: list[str]) -> None:
        fresh = [w for w in set(words) if w not in self.row]
        if not fresh:
            return
        while self.filled + len(fresh) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.filled : self.filled + len(fresh)] = [hashed(w) for w in fresh]
        self.row.update(zip(fresh, range(self.filled, self.filled + len(fresh)), strict=True))
        self.filled += len(fresh)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of all words, each text followed by padding; the texts' starts; their languages (-1: none)."""
        if self.filled > self.most:
            self.clear()
        pad = [0] * (SPANS[-1] if SPANS else 1)
        rows, starts, language = [], [], []
        for text in texts:
            words = WORD.findall(text.lower())
            self.add(words)
            get = self.row.__getitem__
            starts.append(len(rows))
            rows.extend(map(get, words))
            rows.extend(pad)
            found = [n for w in set(words) if (n := LANGUAGE_OF.get(w)) is not None]
            language.append(int(np.bincount(found).argmax()) if found else -1)
        return np.array(rows, np.int64), np.array(starts, np.int64), np.array(language, np.int64)


class Network:
    """Embeddings (padding adds nothing), filters by span and offset, and the logistic unit."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.vectors = (draw.standard_normal((BUCKETS, WIDTH)) * 0.1).astype(np.float32)
        self.filters = {k: (draw.standard_normal((k, WIDTH, FILTERS)) * 0.3).astype(np.float32) for k in SPANS}
        self.bias = {k: np.zeros(FILTERS, np.float32) for k in SPANS}
        self.out = np.full(FILTERS * len(SPANS), 0.5, np.float32)
        self.base = np.float32(-2.0)

    def word_vectors(self, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
        found = self.vectors[table[rows]].sum(axis=1)
        found[rows == 0] = 0
        return found

    def pooled(self, table: np.ndarray, rows: np.ndarray, starts: np.ndarray, where: bool = False):
        """Largest responses of each text by filter; with `where` also their positions and the words."""
        unique, place = np.unique(rows, return_inverse=True)
        vectors = self.word_vectors(table, unique)
        best, at = [], []
        size = len(rows)
        ends = np.append(starts[1:], size)
        for k in SPANS:
            response = np.zeros((size, FILTERS), np.float32)
            for o in range(k):
                by_word = vectors @ self.filters[k][o]
                response[: size - o] += by_word[place[o:]]
            response += self.bias[k]
            np.maximum(response, 0, out=response)
            for o in range(1, k):  # filters that would reach into the next text
                response[ends - o] = 0
            top = np.maximum.reduceat(response, starts, axis=0)
            best.append(top)
            if where:
                at.append(np.stack([starts + [int(c.argmax()) for c in np.split(f, ends[:-1])] for f in response.T], axis=1))
        return np.hstack(best), at, (vectors, place, unique)

    def raw(self, table, rows, starts) -> np.ndarray:
        pooled, _, _ = self.pooled(table, rows, starts)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.base, -30, 30)))

    def train(self, table, texts: list[np.ndarray], y: np.ndarray, steps: int, rate: float = 0.1, batch: int = 32, seed: int = 3):
        """`steps` updates by Adagrad; gradients pass only through the positions that were largest."""
        seen_v = np.full(self.vectors.shape, 1e-4, np.float32)
        seen = {("f", k): np.full(v.shape, 1e-3, np.float32) for k, v in self.filters.items()}
        seen |= {("b", k): np.full(v.shape, 1e-3, np.float32) for k, v in self.bias.items()}
        seen_out, seen_base = np.full(self.out.shape, 1e-3, np.float32), 1e-3
        order, left = np.random.default_rng(seed), steps
        while left > 0:
            for part in np.array_split(order.permutation(len(y)), max(1, len(y) // batch))[:left]:
                left -= 1
                rows = np.concatenate([texts[i] for i in part])
                starts = np.cumsum([0, *(len(texts[i]) for i in part[:-1])])
                pooled, at, (vectors, place, unique) = self.pooled(table, rows, starts, where=True)
                p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.base, -30, 30)))
                error = ((p - y[part]) / len(part)).astype(np.float32)
                back = error[:, None] * self.out * (pooled > 0)
                by_word = np.zeros_like(vectors)
                for s, k in enumerate(SPANS):
                    mine = back[:, s * FILTERS : (s + 1) * FILTERS]
                    grad = np.zeros_like(self.filters[k])
                    for o in range(k):
                        words = place[np.minimum(at[s] + o, len(rows) - 1)]
                        grad[o] = np.einsum("bfd,bf->df", vectors[words], mine)
                        np.add.at(by_word, words.ravel(), (mine[:, :, None] * self.filters[k][o].T[None]).reshape(-1, WIDTH))
                    seen["f", k] += grad**2
                    self.filters[k] -= rate * grad / np.sqrt(seen["f", k])
                    g = mine.sum(0)
                    seen["b", k] += g**2
                    self.bias[k] -= rate * g / np.sqrt(seen["b", k])
                g = pooled.T @ error
                seen_out += g**2
                self.out -= rate * g / np.sqrt(seen_out)
                g = float(error.sum())
                seen_base += g * g
                self.base -= rate * g / np.sqrt(seen_base)
                touched = np.flatnonzero(np.abs(by_word).sum(1) * (unique > 0))
                buckets, inverse = np.unique(table[unique[touched]], return_inverse=True)
                change = np.zeros((len(buckets), WIDTH), np.float32)
                np.add.at(change, inverse.reshape(-1), np.repeat(by_word[touched], table.shape[1], axis=0))
                seen_v[buckets] += change**2
                self.vectors[buckets] -= rate * change / np.sqrt(seen_v[buckets])


class Scorer:
    def __init__(self, network: Network | None, thresholds: np.ndarray):
        self.network, self.thresholds = network, thresholds

    def score(self, words: Words, texts: list[str], most_words: int = 200_000) -> np.ndarray:
        if self.network is None:
            return np.zeros(len(texts))
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < 6 * most_words):
                size += len(texts[end])
                end += 1
            rows, starts, language = words.read(texts[at:end])
            p = self.network.raw(words.table, rows, starts).astype(np.float64)
            t = self.thresholds[language]
            out.append(np.where(p < t, p * THRESHOLD / t, THRESHOLD + (p - t) * (1 - THRESHOLD) / (1 - t)))
            at = end
        return np.concatenate(out) if out else np.zeros(0)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest range of thresholds with the highest F1; 0.5 where a label is missing."""
    if not len(y) or y.min() == y.max():
        return 0.5
    cuts = np.linspace(0.02, 0.98, 97)
    hit = np.array([((p >= c) & (y == 1)).sum() for c in cuts])
    f1 = 2 * hit / np.array([(p >= c).sum() + (y == 1).sum() for c in cuts])
    good = cuts[f1 >= f1.max() - 1e-12]
    return float(np.median(good))


def fit(docs: DataFrame, labels: DataFrame, eligible, label: str = "toxic", per_class: int = 2500, most_chars: int = 24_000_000, steps: int = STEPS) -> Scorer:
    """Train on at most `per_class` labelled documents of each label and `most_chars` characters (documented bounds), whole texts.

    A fifth of them is kept from training to calibrate a threshold for each guessed language; a language
    with too few documents takes the threshold of all.
    """
    sample = labelled_sample(labels, label, eligible, per_class)
    texts = id_and_text(docs).join(F.broadcast(sample), "doc_id")
    # Of each label texts in the order of hashes, very long ones last, as far as half the characters last. One text of each id, so
    # that the window holds the sample only. A label's first text is always taken, of one that is too long the beginning.
    share = most_chars // 2
    order = Window.partitionBy("y").orderBy(F.col("n") > share // 8, F.xxhash64("doc_id"), "doc_id")
    one = texts.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), F.length("text").alias("n"))).alias("t")).select("doc_id", "y", "t.*")
    so_far = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    fitting = one.withColumns({"so_far": so_far, "place": F.row_number().over(order)}).where((F.col("so_far") <= share) | (F.col("place") == 1)).select("doc_id", "hash")
    found = texts.withColumn("hash", F.xxhash64("text")).join(F.broadcast(fitting), ["doc_id", "hash"])
    seen = found.select("doc_id", F.substring("text", 1, share).alias("text"), "y").toPandas()
    seen = seen.sort_values(["doc_id", "text"], kind="stable").drop_duplicates("text")
    y = seen["y"].to_numpy(np.float32)
    if not len(y):
        return Scorer(None, np.full(len(LANGUAGES) + 1, 0.5))
    words = Words(most=1 << 62)
    rows, starts, language = words.read(seen["text"].to_list())
    texts = np.split(rows, starts[1:])
    spare = np.arange(len(y)) % 5 == 0
    network = Network()
    fitted = np.flatnonzero(~spare) if (~spare).any() else np.arange(len(y))
    network.train(words.table, [texts[i] for i in fitted], y[fitted], steps)
    p = np.array([network.raw(words.table, t, np.zeros(1, np.int64))[0] for t in texts])
    judged = spare if y[spare].min(initial=1) < y[spare].max(initial=0) else np.ones(len(y), bool)
    thresholds = np.full(len(LANGUAGES) + 1, best_threshold(p[judged], y[judged]))
    for k in range(len(LANGUAGES)):
        mine = judged & (language == k)
        if min((y[mine] == 0).sum(), (y[mine] == 1).sum()) >= 10:
            thresholds[k] = best_threshold(p[mine], y[mine])
    return Scorer(network, thresholds)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score) of every row of `docs`."""

    def make():
        words = Words()
        return lambda texts: scorer.score(words, texts.to_pylist())

    return id_and_text(docs).select("doc_id", by_text(F.col("text"), "double", make).alias("score"))


def learns_from(column: str = "doc_id"):
    return crc_of_id(column) % 3 != 1


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; labels of held-out rows are not read."""
    return score(docs, fit(docs, labels, learns_from())).select(
        "doc_id", (~learns_from()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
