"""Redaction of texts: licence lines that the corpus itself shows, and plain patterns of personal data.

Licence texts are lines that very many documents share, up to years, versions and the like. So lines are taken by their shape
(lower case, each number as 0). A count sketch over all documents (counters by hash, added up within tasks and then by counter) says which shapes can
be frequent, a second pass counts exactly these, and the frequent ones that speak of licences or rights are the patterns. Texts are never shuffled.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A frequent shape stands in this share of the documents at least, and in LEAST of them.
SHARE, LEAST = 0.002, 5
#: Counters of the sketch: what a task sends at most, and what is broadcast at most (8 bytes each).
COUNTERS = 1 << 18
LICENCE = "licen[cs]|copyright|©|spdx|all rights reserved|lizenz|licencia|droits d.auteur|derechos"
#: Personal data by plain patterns, in this order.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "card": r"\b[0-9](?:[ -]?[0-9]){15,18}\b",
    "phone": r"\+[0-9][ ().0-9-]{6,20}[0-9]",
    "ip": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
}


def shape(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(line)), "[0-9]+", "0")


def shapes(text: Column) -> Column:
    """The distinct shapes of a text's lines; empty lines have none, null texts no line."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"), shape), lambda x: x != ""))


def frequent_shapes(docs: DataFrame, share: float = SHARE, least: int = LEAST, text: str = "text") -> DataFrame:
    """(shape, docs): the shapes of lines that at least max(`least`, `share` of all) documents hold, with the exact number of these.

    A shape counts into the counter of its hash, so one in a counter below the threshold is not frequent; the others are
    counted one by one. A document counts once however often it repeats a line; null texts are documents without lines.
    """
    wanted = max(least, ceil(share * docs.count()), 1)
    rows = docs.select(F.explode(shapes(F.col(text))).alias("shape")).withColumn("counter", F.pmod(F.xxhash64("shape"), F.lit(COUNTERS)))
    full = rows.groupBy("counter").agg(F.count("*").alias("n")).where(F.col("n") >= wanted).select("counter")
    rows = rows.join(F.broadcast(full), "counter", "left_semi")
    return rows.groupBy("shape").agg(F.count("*").alias("docs")).where(F.col("docs") >= wanted)


def licence_shapes(docs: DataFrame, share: float = SHARE, least: int = LEAST, text: str = "text") -> DataFrame:
    return frequent_shapes(docs, share, least, text).where(F.col("shape").rlike(LICENCE))


def without_frequent_lines(docs: DataFrame, share: float = SHARE, least: int = LEAST, text: str = "text") -> DataFrame:
    """`docs` without the lines whose shape is frequent in the corpus; every row and other column stays, null texts too.

    Only digests of frequent shapes, of which there are few by definition, go to the tasks; texts stay where they are.
    """
    known = [r[0] for r in frequent_shapes(docs, share, least, text).select(F.sha2("shape", 256)).collect()]
    if not known:
        return docs
    rest = F.filter(F.split(F.col(text).cast("string"), "\n"), lambda x: ~F.sha2(shape(x), 256).isin(known))
    return docs.withColumn(text, F.array_join(rest, "\n"))


def redacted(docs: DataFrame, share: float = SHARE, least: int = LEAST, text: str = "text") -> DataFrame:
    """`docs` with licence lines as [licence] and personal data as its kind in brackets; every row and other column stays, null texts too.

    The driver gets digests of at most 1 / `share` shapes for each line of a mean document.
    """
    known = [r[0] for r in licence_shapes(docs, share, least, text).select(F.sha2("shape", 256)).collect()]
    out = F.col(text).cast("string")
    if known:
        out = F.array_join(F.transform(F.split(out, "\n"), lambda x: F.when(F.sha2(shape(x), 256).isin(known), F.lit("[licence]")).otherwise(x)), "\n")
    for kind, pattern in KINDS.items():
        out = F.regexp_replace(out, pattern, f"[{kind}]")
    return docs.withColumn(text, out)
