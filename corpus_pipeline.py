"""A corpus pipeline: each stage reads what its predecessor kept and writes what it keeps itself.

Stages that filter or rewrite keep every column of their input as it is, extra ones and clashing names included, but for
`text` and, where it is there, `n_chars`. Null texts are empty, null ids stay null, empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import minhash, packing, pii, quality, suffixes
from weftline.llm.common import discard, materialize, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects; it is fitted on these documents and their labels.

    Empty and null texts get the score of an empty text; without labels all documents stay. Repeated rows stay or go together.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep the document with the smallest id.

    Rows without an id and texts without words stay; rows that repeat an id stay or go together.
    """
    return minhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every byte out that a 100-byte string covers which also starts earlier.

    Every row stays, with an empty text where nothing is left. Rows without an id come last.
    """
    return suffixes.drop_repeated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the kind of it in brackets. Every row stays."""
    return pii.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack what is left; an empty text is one piece that holds the end id."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("pii", personal_data),
    ("packing", sequences),
]

#: Classifying, MinHash, byte-wise dedup and tokenizing are not SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        held.append(docs)
        if len(held) > 1:  # what a stage has read is no longer needed once it has written
            discard(held.pop(0))
    return STAGES[-1][1](spark, docs, sf_dir)
