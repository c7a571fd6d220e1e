"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each document gets a rate, the copies of it that the mix takes on average. Of all rates with which every source takes
its target of words and no rate exceeds MOST, the ones nearest to 1 in relative entropy are min(MOST, exp(l * x)), with x the
document's words against its source's mean and one multiplier l for each source: the variables of the convex dual. Newton iterations find them; each
is one aggregation over the histogram of (source, words), which has a row for each length of a source however many documents have it. A
step goes from the logarithm of what a source takes to that of its target and stays in a bracket that shrinks, so it ends for every source.

Rates become whole copies by cumulated rounding: within a source lengths are ordered from the longest on, and a length takes as
many copies as the rounded sum of rates grows there. What a source takes then misses its target by half of its longest document at most;
that rest is given to, or taken from, a part of one copy of one document. Documents of one length are ranked by hash,
in sub-buckets of about SUB rows, so neither a hot source nor a hot length meets in one task.

Sums of rates are exact decimals, so the order of rows changes nothing and reruns agree. Sources are ordered by code point, null
last. Null texts have no words; documents without words take none. Rows that repeat an id are documents of their own;
ties (equal id and text) are alike, so any of them may take the copy more. Very long texts are one document. An empty table has no rows.
Other columns, whatever their names, are ignored by `mix` and kept by `drawn`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import discard, materialize, quoted
from weftline.operators.order import before

#: Most copies of a document, and of a source's words.
MOST = 3.0
WEIGHTS = (1, 2, 3)
#: Rows of a length that are ranked together, about.
SUB = 512
#: Words by which a source may miss its target when Newton's iterations end.
NEAR = 0.25
WORD = "[^\\x20\\x09-\\x0D]+"
EXACT = "decimal(30,6)"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, src, size, h): words of every row, a key that orders sources as asked, and a hash to rank by."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    source = quoted(source_col).cast("string")
    doc_id = quoted(id_col).cast("long")
    return docs.select(
        doc_id.alias("doc_id"),
        F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("src"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(doc_id, text).alias("h"),
    )


def targets(histogram: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(src, source_size, target, least, mean): sources with their targets, smallest length above 0 and mean length.

    Shares by weight; sources over `most` times their size stop there, and the others share what is left, until none is over.
    """
    own = histogram.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("filled"))
    place = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    rows = before(own, [F.col("src")], {"place": F.lit(1)}).select("src", "source_size", "least", (F.col("source_size") / F.col("filled")).alias("mean"), place.alias("weight"))
    rows = materialize(rows.withColumn("most", F.lit(most) * F.col("source_size")), "sources")
    total = rows.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level = 0.0
    while True:  # each round stops at least one source more
        over = F.lit(level) * F.col("weight") > F.col("most")
        sums = rows.agg(F.sum(F.when(over, F.col("most"))).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        fresh = (total - (sums["full"] or 0.0)) / sums["weight"] if sums["weight"] else level
        if fresh <= level:
            break
        level = fresh
    return rows.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.col("most")))


def rate(x: str = "x", l: str = "l", most: float = MOST):  # noqa: E741
    """Exponentially tilted; the exponent is bounded first, so that nothing overflows."""
    tilt = F.col(l) * F.col(x)
    return F.when(tilt >= F.log(F.lit(most)), F.lit(most)).otherwise(F.exp(F.greatest(tilt, F.lit(-700.0))))


def multipliers(histogram: DataFrame, sources: DataFrame, most: float = MOST) -> DataFrame:
    """(src, l): the dual's solution for every source that has words."""
    x = F.col("size") / F.col("mean")
    base = materialize(histogram.where("size > 0").join(sources.where("source_size > 0").select("src", "mean"), "src").select("src", "n", "size", x.alias("x")), "tilts")
    bottom = F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size"))) * F.col("mean") / F.col("least")
    top = F.when(F.col("target") > F.col("source_size"), F.log(F.lit(most)) * F.col("mean") / F.col("least")).otherwise(0.0)
    # Where all documents are taken `most` times, or each once, the answer is an end of the bracket.
    start = F.when(F.col("target") >= F.lit(most) * F.col("source_size"), F.col("high")).otherwise(0.0)
    state = sources.where("source_size > 0").withColumns({"low": bottom, "high": top})
    state = materialize(state.select("src", "target", "low", "high", start.alias("l"), F.lit(False).alias("done")), "multipliers")
    mass = F.col("n") * F.col("size") * rate(most=most)
    inner = F.col("l") * F.col("x") < F.log(F.lit(most))
    while True:
        sums = base.join(state.where("not done").select("src", "l"), "src").groupBy("src").agg(
            F.sum(mass.cast(EXACT)).cast("double").alias("f"), F.sum(F.when(inner, mass * F.col("x")).otherwise(0.0).cast(EXACT)).cast("double").alias("slope")
        )
        rows = state.join(sums, "src", "left")
        miss = F.col("f") - F.col("target")
        low = F.when(miss < 0, F.greatest("low", "l")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.least("high", "l")).otherwise(F.col("high"))
        step = F.col("l") + F.log(F.col("target") / F.col("f")) * F.col("f") / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high"))
        now_done = F.col("done") | (F.abs(miss) <= NEAR) | (F.col("high") - F.col("low") <= 1e-12 * (F.abs("high") + F.abs("low")))
        rows = rows.withColumns({"low": low, "high": high, "done": now_done})
        rows = rows.withColumn("l", F.when(F.col("done"), F.col("l")).otherwise(F.when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)))
        fresh = materialize(rows.select("src", "target", "low", "high", "l", "done"), "multipliers")
        discard(state)
        state = fresh
        if state.where("not done").isEmpty():
            discard(base)
            return state.select("src", "l")


def shares(histogram: DataFrame, sources: DataFrame, solved: DataFrame, most: float = MOST) -> DataFrame:
    """(src, size, n, rate, base, extra, cut): for each length of a source whole copies of every document, how many documents
    get one more, and the words by which the first document by rank differs from whole copies."""
    rows = histogram.join(sources.select("src", "mean", "target"), "src").join(solved, "src", "left")
    rows = rows.withColumn("x", F.col("size") / F.col("mean")).withColumn("rate", F.when(F.col("size") > 0, F.coalesce(rate(most=most), F.lit(0.0))).otherwise(0.0))
    down = Window.partitionBy("src").orderBy(F.desc("size"))
    upto = F.sum((F.col("rate") * F.col("n")).cast("decimal(30,9)")).over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    rows = rows.withColumn("upto", F.round(upto).cast("long"))
    full = (F.lit(most) * F.col("n")).cast("long")
    rows = rows.withColumn("copies", F.least(full, F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0))))
    whole = Window.partitionBy("src")
    rest = F.round("target").cast("long") - F.sum(F.col("copies") * F.col("size")).over(whole)
    # The least length that can take or give the rest; where none is as long, the longest that can.
    able = (F.col("size") > 0) & F.when(F.col("rest") > 0, F.col("copies") < full).otherwise(F.col("copies") > 0)
    enough = F.col("size") >= F.abs("rest")
    rows = rows.withColumn("rest", rest).withColumn("bearer", F.coalesce(F.min(F.when(able & enough, F.col("size"))).over(whole), F.max(F.when(able, F.col("size"))).over(whole)))
    part = F.signum("rest").cast("long") * F.least(F.abs("rest"), F.col("size"))
    cut = F.when(F.col("size") == F.col("bearer"), part).otherwise(F.lit(0).cast("long"))
    base = F.floor(F.col("copies") / F.col("n")).cast("long")
    return rows.select("src", "size", "n", "rate", base.alias("base"), (F.col("copies") - base * F.col("n")).alias("extra"), cut.alias("cut"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = 3, **columns: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken, rate, h): what the mix takes of every row of `docs`.

    `taken` is a whole number of copies but for one document of a source at most, and never over `most` times `size`.
    """
    if most < 1 or min(weights) <= 0:
        raise ValueError("`most` has to be at least 1 and weights positive")
    rows = materialize(measured(docs, **columns), "sizes")
    histogram = materialize(rows.groupBy("src", "size").agg(F.count("*").alias("n")), "lengths")
    sources = materialize(targets(histogram, weights, float(most)), "targets")
    plan = materialize(shares(histogram, sources, multipliers(histogram, sources, float(most)), float(most)), "shares")
    sub = F.pmod(F.col("h"), F.ceil(F.col("n") / SUB)).cast("long")
    placed = materialize(rows.join(plan, ["src", "size"]).select("doc_id", "src", "size", "h", "rate", "base", "extra", "cut", F.col("n").alias("alike"), sub.alias("sub")), "placed")
    discard(rows, histogram, plan)
    # A row's rank among its length is its rank in its sub-bucket and what stands in the ones before.
    some = (F.col("extra") > 0) | (F.col("cut") != 0)
    counts = placed.where(some).groupBy("src", "size", "sub").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("src", "size").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("src", "size", "sub", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("src", "size", "sub").orderBy("h", "doc_id")
    ranked = placed.where(some).withColumn("rank", F.row_number().over(inside)).join(counts, ["src", "size", "sub"]).withColumn("rank", F.col("rank") + F.col("ahead")).drop("ahead", "sub")
    # A rest that is missing goes to the first document without the copy more, one that is over comes from the first with one (or, without any, from the first).
    bearer = F.when(F.col("cut") > 0, F.col("extra") + 1).otherwise(1)
    taken = (F.col("base") + (F.col("rank") <= F.col("extra")).cast("long")) * F.col("size") + F.when(F.col("rank") == bearer, F.col("cut")).otherwise(0)
    names = ["doc_id", "src", "size", "h", "rate"]
    done = ranked.select(*names, taken.alias("taken")).unionByName(placed.where(~some).select(*names, (F.col("base") * F.col("size")).alias("taken")))
    return done.join(sources.select("src", "source_size", "target"), "src").select("doc_id", "size", "source_size", "target", "taken", "rate", "h")


def drawn(docs: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken, with `copy` (from 1) and the words of a cut copy only in `words`.

    A whole copy has null there; a cut one the number of its leading words. Rows that nothing is taken of are left out.
    """
    if "copy" in docs.columns or "words" in docs.columns:
        raise ValueError("columns copy and words are there already")
    plan = mix(docs, weights, most).where("taken > 0").select("doc_id", "h", "size", "taken").groupBy("doc_id", "h").agg(F.first("size").alias("size"), F.sum("taken").alias("taken"), F.count("*").alias("rows"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    key = F.col("row.doc_id").cast("long")
    rows = docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias("row")).withColumns({"id": key, "k": F.xxhash64(key, text)})
    rows = rows.dropDuplicates(["id", "k"]).join(plan, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("h")))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")).cast("long")))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    out = rows.withColumn("copy", copies).withColumn("words", F.when(left < F.col("size"), left))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), "copy", "words")
