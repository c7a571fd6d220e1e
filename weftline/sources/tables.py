"""Reading the tables of a folder, and writing and reading other formats."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Make the tables that a statement names temporary views; statements keep the folder they were analysed with."""
    words = set(re.findall(r"\w+", text))
    for name in TABLES:
        if name in words:
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, from spark.checkpoint.dir.

    Only where that is unset and everything runs in one process (tests), a local folder is set for this application.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
        folder = context.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: computed once, and still there when an executor is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def through(df: DataFrame, kind: str, **options) -> DataFrame:
    """Write `df` in a format and read it back with its schema."""
    path = scratch(df.sparkSession, kind)
    df.write.format(kind).options(**options).save(path)
    return df.sparkSession.read.format(kind).schema(df.schema).options(**options).load(path)


def through_text(df: DataFrame, column: str) -> DataFrame:
    """Write one column as lines of text and read them back; line breaks in a value would part it."""
    path = scratch(df.sparkSession, "text")
    df.select(df[column].alias("value")).write.text(path)
    return df.sparkSession.read.text(path).withColumnRenamed("value", column)


def write_parts(df: DataFrame, path: str, by: str) -> None:
    """Write `df` partitioned by a column; of what is there only the partitions that `df` has rows of are replaced.

    Rows are dealt by that column and a hash of the whole row, so a partition with very many rows is as many files, not one task.
    """
    spread = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(8))
    df.repartition(F.col(f"`{by}`"), spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_buckets(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """Write `df` as a table in `buckets` by the hash of a column, sorted within; joins of two such tables on it need no exchange."""
    df.repartition(buckets, F.col(f"`{by}`")).write.mode("overwrite").format("parquet").bucketBy(buckets, by).sortBy(by).option("path", scratch(df.sparkSession, name)).saveAsTable(name)
    return df.sparkSession.table(name)


def read_lines(spark: SparkSession, path: str, kind: str, schema: str, bad: str = "_corrupt", **options) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of csv or json files: rows that do not fit the schema come whole, as text, in the second table's only column.

    Nothing is dropped: every line of the input is in one of the two.
    """
    whole = f"{schema}, `{bad}` string"
    rows = spark.read.format(kind).schema(whole).options(mode="PERMISSIVE", columnNameOfCorruptRecord=bad, **options).load(path)
    rows = kept(rows, "parsed")  # a query of the corrupt column alone would not parse the others
    return rows.where(F.col(bad).isNull()).drop(bad), rows.where(F.col(bad).isNotNull()).select(bad)
