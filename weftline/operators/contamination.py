"""Which documents hold word runs of a benchmark, and how much of each item they cover.

The items' runs are hashed into a Bloom filter that Spark builds by aggregation. The scan of the documents hashes every run and tests
it there, before any exchange, so that what is shuffled is what the filter lets through and not the runs of the corpus. Hits are then held
against the items' hashes, and only documents with a true hit give their runs as text, which are joined exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.tables import kept

RUN = 8
#: Words of 64 bits that a filter may have (16 MB); beyond that runs are joined by their hashes without a filter.
MOST_WORDS = 1 << 21
#: Ids of documents with a hit that are broadcast (8 bytes each, before hashing).
MOST_HITS = 1_000_000
#: Bits of the filter for each run, at least.
BITS = 16


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def bound(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is read, within lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def joined(a: Column, b: Column, apart: int) -> Column:
    """Hashes of the runs that are made of a run of `a` and the run of `b` that begins `apart` words after it."""
    some = F.sequence(F.lit(0), F.size(b) - apart - 1)
    return F.when(F.size(b) > apart, F.transform(some, lambda i: F.xxhash64(F.get(a, i), F.get(b, i + apart)))).otherwise(F.array().cast("array<bigint>"))


def hashed(w: Column, run: int) -> Column:
    """The hash of every run of `run` words of an array, from the words' own hashes by doubling."""

    def longer(part: Column, have: int, out: Column | None, done: int) -> Column:
        if run & have:
            if out is None:
                return part if have == run else bound(joined(part, part, have), lambda p: longer(p, 2 * have, part, have))
            if done + have == run:
                return joined(out, part, done)
            return bound(joined(out, part, done), lambda o: bound(joined(part, part, have), lambda p: longer(p, 2 * have, o, done + have)))
        return bound(joined(part, part, have), lambda p: longer(p, 2 * have, out, done))

    return bound(F.transform(w, lambda x: F.xxhash64(x)), lambda p: longer(p, 1, None, 0))


def runs_of(w: str, run: int) -> Column:
    """Every run of words with its hash."""
    return bound(F.col(w), lambda x: F.transform(hashed(x, run), lambda h, i: F.struct(h.alias("h"), F.slice(x, i + 1, run).alias("run"))))


def bit_of(h: Column, k: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 40 + 6 * k).bitwiseAND(63).cast("int"))


def mask(h: Column) -> Column:
    """Three bits of a word of 64."""
    return bit_of(h, 0).bitwiseOR(bit_of(h, 1)).bitwiseOR(bit_of(h, 2))


def bloom(hashes: DataFrame, size: int) -> DataFrame:
    """One row, one column: the filter of hashes (h) as an array of `size` (a power of two) words."""
    at = F.col("h").bitwiseAND(size - 1)
    empty = hashes.sparkSession.range(size).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("bits"))
    filled = hashes.select(at.alias("at"), mask(F.col("h")).alias("bits")).unionByName(empty).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda x: x.bits).alias("filter"))


def runs_of_items(items: DataFrame, run: int, most_words: int) -> tuple[DataFrame, DataFrame, Column]:
    """Of items (item_id, w): (item_id, item_words, at, h, run) of every run, their distinct hashes, and whether the column `h` may be one of them."""
    runs = items.select("item_id", F.size("w").alias("item_words"), F.posexplode(runs_of("w", run)).alias("at", "r"))
    runs = kept(runs.select("item_id", "item_words", "at", "r.h", "r.run"), "item-runs")
    known = runs.select("h").distinct()
    size = 64
    while size * 64 < BITS * known.count():
        size *= 2
    if size > most_words:
        return runs, known, F.lit(True)
    word = F.get(bloom(known, size).scalar(), F.col("h").bitwiseAND(size - 1).cast("int"))
    return runs, known, word.bitwiseAND(mask(F.col("h"))) == mask(F.col("h"))


def runs_found(docs: DataFrame, known: DataFrame, maybe: Column, run: int) -> DataFrame:
    """(doc_id, run): the distinct runs of those documents (doc_id, w) that hold a known one, as far as `maybe` lets them through."""
    hits = docs.select("doc_id", hashed(F.col("w"), run).alias("all")).select("doc_id", F.explode("all").alias("h"))
    hit = kept(hits.where(maybe).join(known, "h", "left_semi").select("doc_id").distinct(), "hit-documents")
    # So few documents are found in place; only where they are very many are texts shuffled to them.
    few = F.broadcast(hit) if hit.count() <= MOST_HITS else hit
    texts = docs.join(few, "doc_id", "left_semi").select("doc_id", F.explode(runs_of("w", run)).alias("r")).select("doc_id", "r.h", "r.run")
    return texts.where(maybe).select("doc_id", "run").distinct()


def run_counts(docs: DataFrame, items: DataFrame, split, run: int = RUN, most_words: int = MOST_WORDS) -> DataFrame:
    """(doc_id, item_id, shared): distinct runs of `run` words that a document and an item share; `split` makes words of the column `text`.

    As in `shared_runs`, runs are tested at the scan and only what the items may hold is shuffled. Rows of one id are one document
    or item, and so are those without an id. Null texts have no words.
    """
    # An id stands in a struct, as a null inside one equals another null.
    worded = lambda df, i: df.select(F.struct(i).alias(i), split(F.coalesce("text", F.lit(""))).alias("w"))
    runs, known, maybe = runs_of_items(worded(items, "item_id"), run, most_words)
    found = runs_found(worded(docs, "doc_id"), known, maybe, run)
    counts = found.join(runs.select("item_id", "run").distinct(), "run").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    return counts.select("doc_id.doc_id", "item_id.item_id", "shared")


def shared_runs(docs: DataFrame, items: DataFrame, run: int = RUN, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """(doc_id, item_id, shared, covered, item_words, share, passages) of every pair that shares a run of `run` words.

    `shared` counts the distinct runs, `covered` the item's words that they cover, `share` is that part of its words and
    `passages` counts the stretches of touching runs. The filter is broadcast while it has at most `most_words` words, which is
    checked; beyond that the hashes are joined by a shuffle. Null texts have no words; null ids are in no pair; rows that repeat an id count as
    one document or item with all their runs, and of a repeated item the longest text counts for `item_words`. Empty tables give no pairs.
    Columns other than the named ones are ignored. Very long texts are taken whole.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w")).where("doc_id IS NOT NULL")
    items = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).where("item_id IS NOT NULL")
    runs, known, maybe = runs_of_items(items, run, most_words)
    found = runs_found(docs, known, maybe, run)
    pairs = found.join(runs, "run").groupBy("doc_id", "item_id", "at").agg(F.first("run").alias("run"), F.max("item_words").alias("item_words"))
    ahead = F.lead("at").over(Window.partitionBy("doc_id", "item_id").orderBy("at")) - F.col("at")
    gap = pairs.withColumn("gap", F.coalesce(ahead, F.lit(run + 1)))
    out = gap.groupBy("doc_id", "item_id").agg(F.count_distinct("run").alias("shared"), F.sum(F.least("gap", F.lit(run))).alias("covered"), F.max("item_words").cast("long").alias("item_words"), F.count_if(F.col("gap") > run).alias("passages"))
    return out.select("doc_id", "item_id", "shared", "covered", "item_words", F.round(F.col("covered") / F.col("item_words"), 6).alias("share"), "passages")
