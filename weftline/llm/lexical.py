"""Ranked lexical search by a threshold-seeded join: each item's best documents by term weights, exactly.

Documents become a forward index: one row with the numbers of the items' terms in it and how often each occurs. Two
aggregations over it give what scores depend on (documents, occurrences, documents by term) and, for each term, its largest and its
k-th largest impact. The k-th impact of any of its terms, times the term's repeats, is a score that k documents reach, so the
largest such product seeds an item's threshold. An item's terms are then ordered by largest impact; the terms behind which
all that is left cannot reach the threshold are pruned: a document that holds none of the terms before them is no candidate.
Each task joins the postings of its documents with the terms that remain, scores the candidates exactly from the forward
index, raises the threshold to the k-th score that it has seen and passes on what reaches it.

Items are the query set: they are taken in blocks of about BLOCK bytes, one index and one search a block, so what is broadcast is
bounded. Documents are never gathered; a task gives at most k rows an item.

Null texts have no terms, neither as items nor as documents; items and documents without terms are in no result. Rows that repeat
an item id are items of their own with ranks of their own, rows that repeat a document id are documents of their own. Ties go to the smaller
id, null ids last. Very long texts are taken whole. Empty tables give no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.anchors import steps
from weftline.llm.common import discard, materialize, quoted

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Bytes of item texts that are searched at once.
BLOCK = 4_000_000
#: Documents that a task scores together.
TOGETHER = 8192
EXACT = 2**53

ORACLE = r"""
WITH item AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
terms AS (SELECT item_id, term, count(*) AS c FROM item GROUP BY 1, 2),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY 1),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
postings AS (SELECT doc_id, term, count(*) AS tf FROM runs WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM postings, whole GROUP BY term, docs),
scored AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM terms JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), whole GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""


def terms_of(text: str | None) -> Counter:
    """Terms of a text and how often each occurs; only A-Z are lower-cased, before or after, as they are in any term."""
    if not text:
        return Counter()
    return Counter(TERM.findall(text.lower() if text.isascii() else text.translate(LOWER)))


def forward(docs: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """(doc_id, n, terms, tf) of documents with terms: the known terms' numbers and their occurrences, as packed 32-bit integers."""

    def index(batches):
        known = numbers.get
        for batch in batches:
            ids, rows = [], []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                found = terms_of(text.as_py())
                if found:
                    own = sorted((k, c) for t, c in found.items() if (k := known(t)) is not None)
                    pair = np.array(own, np.int32).reshape(-1, 2)
                    ids.append(doc_id.as_py())
                    rows.append((sum(found.values()), pair[:, 0].tobytes(), pair[:, 1].tobytes()))
            n, terms, tf = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(index, "doc_id long, n long, terms binary, tf binary")


class Postings:
    """The postings of some documents, by document and, once asked for, by term; impacts are exact integers."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, docs: int, total: int):
        self.ids = batch.column("doc_id")
        n = batch.column("n").to_numpy()
        if int(n.max(initial=0)) * 25 * docs >= 2**63:
            m = np.array([75 + 25 * int(x) * docs // total for x in n], np.int64)
        else:
            m = 75 + 25 * n * docs // total
        sizes = np.array([len(x) // 4 for x in batch.column("terms").to_pylist()], np.int64)
        term = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32)
        tf = np.frombuffer(b"".join(batch.column("tf").to_pylist()), np.int32).astype(np.int64)
        doc = np.repeat(np.arange(len(n)), sizes)
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.term, self.doc, self.impact = term[order], doc[order], impact[order]
        self.first = np.searchsorted(self.term, np.arange(len(weights) + 1))

    def of(self, terms: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts, times repeats, of the postings of `terms`."""
        sizes = self.first[terms + 1] - self.first[terms]
        at = np.repeat(self.first[terms], sizes) + steps(sizes)
        return self.doc[at], self.impact[at] * np.repeat(repeats, sizes)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(at, TOGETHER)


def impacts(index: DataFrame, weights: np.ndarray, docs: int, total: int, k: int) -> DataFrame:
    """(term, best, kth): for each term number its largest impact and its k-th largest, 0 where fewer documents hold it."""

    def largest(batches):
        held = [np.zeros((0, 2), np.int64)]
        for batch in chunks(batches):
            own = Postings(batch, weights, docs, total)
            held = [top(np.concatenate([*held, np.stack([own.term.astype(np.int64), own.impact], axis=1)]))]
        found = np.concatenate(held)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].astype(np.int32)), pa.array(found[:, 1])], ["term", "impact"])

    def top(rows: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort((-rows[:, 1], rows[:, 0]))]
        first = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
        return rows[steps(np.diff(np.append(first, len(rows)))) < k]

    rows = index.mapInArrow(largest, "term int, impact long")
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))
    kept = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    return kept.groupBy("term").agg(F.max("impact").alias("best"), F.coalesce(F.max(F.when(F.col("rank") == k, F.col("impact"))), F.lit(0)).cast("long").alias("kth"))


def planned(items: list[Counter], numbers: dict[str, int], best: np.ndarray, kth: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int, int, bool]]:
    """For each item its terms by falling bound, their repeats, how many of them make candidates, the threshold, and whether sums stay exact in doubles."""
    out = []
    for found in items:
        terms = np.array([numbers[t] for t in found], np.int64)
        repeats = np.array(list(found.values()), np.int64)
        bound = best[terms] * repeats
        order = np.lexsort((terms, -bound))
        terms, repeats, bound = terms[order], repeats[order], bound[order]
        seed = max(1, int((kth[terms] * repeats).max(initial=0)))  # scores of 0 do not count
        left = np.append(np.cumsum(bound[::-1])[::-1], 0)  # what documents without the terms before can reach
        out.append((terms, repeats, int(np.argmax(left < seed)), seed, int(bound.sum()) < EXACT))
    return out


def searched(index: DataFrame, plans: list, weights: np.ndarray, docs: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): of each task's documents the k best for each item that reach its threshold."""

    def search(batches):
        floor = [p[3] for p in plans]
        held: list[list[tuple[int, int, int | None]]] = [[] for _ in plans]
        for batch in chunks(batches):
            own = Postings(batch, weights, docs, total)
            size = batch.num_rows
            for i, (terms, repeats, lead, _, exact) in enumerate(plans):
                if not lead:
                    continue
                candidate = np.zeros(size, bool)
                candidate[own.of(terms[:lead], repeats[:lead])[0]] = True
                if not candidate.any():
                    continue
                doc, impact = own.of(terms, repeats)
                if exact:
                    score = np.bincount(doc, impact, size).astype(np.int64)
                else:
                    score = np.zeros(size, np.int64)
                    np.add.at(score, doc, impact)
                some = np.flatnonzero(candidate & (score >= floor[i]))
                if len(some) > k:  # of ties with the k-th all stay here
                    some = some[score[some] >= np.partition(score[some], -k)[-k]]
                rows = [(-int(score[j]), x is None, x) for j, x in zip(some, own.ids.take(pa.array(some)).to_pylist(), strict=True)]
                held[i] = sorted(held[i] + rows)[:k]
                if len(held[i]) == k:
                    floor[i] = max(floor[i], -held[i][-1][0])
        rows = [(i, x, -less) for i, own in enumerate(held) for less, _, x in own]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return index.mapInArrow(search, "item int, doc_id long, score long")


def blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int | None, Counter]]]:
    """(item_id, terms) of the items that have terms, about `size` bytes of texts at a time."""
    block, held = [], 0
    for row in items.where(F.length("text") > 0).toLocalIterator():
        if found := terms_of(row["text"]):
            block.append((row["item_id"], found))
            held += len(row["text"])
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0."""
    spark = docs.sparkSession
    docs = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    items = items.select(quoted(item_col).cast("long").alias("item_id"), quoted(item_text).cast("string").alias("text"))
    out, schema = [], "item_id long, rank int, doc_id long, score long"
    for part in blocks(items, block):
        numbers = {t: i for i, t in enumerate(dict.fromkeys(t for _, found in part for t in found))}
        index = materialize(forward(docs, numbers), "forward")
        docs_n, total = index.agg(F.count("*"), F.sum("n")).first()
        if not docs_n:
            return spark.createDataFrame([], schema)
        df = np.zeros(len(numbers), np.int64)
        for term, n in held_by(index).toLocalIterator():
            df[term] = n
        weights = np.array([int(np.floor(1000 * np.log((2 * docs_n + 2) / (2 * x + 1)))) for x in df.tolist()], np.int64)
        best, kth = np.zeros((2, len(numbers)), np.int64)
        for term, most, kth_most in impacts(index, weights, docs_n, total, k).toLocalIterator():
            best[term], kth[term] = most, kth_most
        plans = planned([found for _, found in part], numbers, best, kth)
        found = searched(index, plans, weights, docs_n, total, k)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(part)], "item int, item_id long")
        rows = found.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "item")
        out.append(materialize(rows.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked"))
        discard(index)
    if not out:
        return spark.createDataFrame([], schema)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def held_by(index: DataFrame) -> DataFrame:
    """(term, n): how many documents hold each term; a task adds up its own first."""

    def count(batches):
        found = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32))
            size = max(len(own), len(found))
            found = np.pad(found, (0, size - len(found))) + np.pad(own, (0, size - len(own)))
        term = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(found[term])], ["term", "n"])

    return index.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
