"""What several corpus operators share: input columns, shared scratch space and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null document id is treated as this one: later than every real id.
NO_ID = np.iinfo(np.int64).max


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row; a null text becomes the empty text, other columns are dropped."""
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))


def wrapped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, row): as `id_and_text`, with the whole row beside it, so that no column of it can meet one of ours."""
    whole = F.struct(*(quoted(c) for c in docs.columns)).alias("row")
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"), whole)


def unwrapped(rows: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The columns `names` of wrapped rows, some of them replaced."""
    return rows.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in names))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the setting is absent and everything runs in one process (tests), a local one is set for this session.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="weftline-")
        context.setCheckpointDir(folder)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: computed once, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what `materialize` wrote; nothing that is still to be computed may read it."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def trimmed() -> None:
    """Give memory that a worker has freed back to the system, so that idle workers do not hold the peak of their last task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and the n+1 offsets of its rows in them."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def stretches(texts: pa.Array, size: int = 4_000_000) -> list[tuple[int, int]]:
    """Rows to take together, as first row and count: about `size` bytes of whole texts."""
    block = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // size
    first = np.flatnonzero(np.diff(block, prepend=-1))
    return list(zip(first.tolist(), np.diff(np.append(first, len(texts))).tolist(), strict=True))


def by_text(column: Column, kind: str, make) -> Column:
    """A value of every text, from the function that `make()` gives each task for a few MB of whole texts at a time.

    Only the texts go to Python and only the values come back. Nulls count as empty texts.
    """

    def apply(chunks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = make()
        for texts in chunks:
            texts = texts.fill_null("")
            yield pa.concat_arrays([pa.array(each(texts.slice(at, n))) for at, n in stretches(texts)] or [pa.array(each(texts))])
        del each
        trimmed()

    return F.arrow_udf(apply, kind)(column)


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def labelled_sample(labels: DataFrame, label: str, eligible, per_class: int) -> DataFrame:
    """At most `per_class` eligible rows of each label as (doc_id, y), the same rows on every run.

    Ids labelled more than once keep their largest label. The result is bounded, so it may be broadcast.
    """
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & eligible)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    order = F.xxhash64("doc_id")
    pick = [rows.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    return pick[0].unionByName(pick[1])
