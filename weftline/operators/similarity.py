"""Exact cosine top-k without comparing all components of all pairs.

Vectors are scaled to length 1 and turned so that their first components hold most of what they differ in (principal axes of a
bounded sample; turning changes no product). For a pair, the product of the first components plus the product of the
lengths of what is left bounds the cosine (Cauchy-Schwarz). Only pairs whose bound reaches the query's k-th best so far are
multiplied out, from the vectors as they were. Candidates are range-partitioned by the length of their rest, so that the tightest bounds come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.tables import kept

#: Vectors that the axes and first thresholds come from; components that are multiplied for all pairs; bytes of queries at once.
SAMPLE, HEAD, QUERY_BYTES = 2048, 16, 16_000_000
TOGETHER, DIGITS, SLACK = 2048, 9, 1e-9
#: Queries whose bounds stand in memory at once, for TOGETHER candidates each (8 MB a table of them).
AT_ONCE = 512


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    ends = np.cumsum([0, *column.value_lengths().to_pylist()])
    flat, out = column.flatten().to_numpy(zero_copy_only=False), np.zeros((len(column), size))
    lengths = np.diff(ends)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(ends[-1]) - np.repeat(ends[:-1], lengths)] = flat
    return out


def units(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, unit) of the rows with a direction: no null, NaN or infinite component, and not all zero."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.withColumn("most", F.array_max(F.transform("v", lambda x: F.abs(x)))).where("most > 0")

    def scaled(batches):
        for batch in batches:
            lists = batch.column("v")
            size = max(lists.value_lengths().to_pylist(), default=0)
            x = matrix(lists, size) / batch.column("most").to_numpy()[:, None]  # first by the largest, so that nothing overflows
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(x), pa.list_(pa.float64()))], ["id", "unit"])

    return rows.mapInArrow(scaled, "id long, unit array<double>")


class Turned:
    """Vectors along the axes: their first components and the length of the rest."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        turned = x @ axes
        self.head, self.rest = turned[:, :HEAD], np.sqrt((turned[:, HEAD:] ** 2).sum(axis=1))


def best(ids: np.ndarray, x: np.ndarray, axes: np.ndarray, queries: np.ndarray, q: np.ndarray, turned: Turned, held: list, k: int) -> int:
    """Take candidates into each query's `held` best (-score, id); the number of pairs that were multiplied out."""
    own, worked = Turned(x, axes), 0
    for at in range(0, len(queries), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        floor = np.array([-h[-1][0] if len(h) == k else -2.0 for h in held[part]])
        open_ = own.head @ turned.head[part].T + own.rest[:, None] * turned.rest[None, part] + SLACK >= floor[None, :]
        open_ &= ids[:, None] != queries[None, part]
        for j in np.flatnonzero(open_.any(axis=0)).tolist():
            some = np.flatnonzero(open_[:, j])
            worked += len(some)
            score = np.round(np.einsum("ij,j->i", x[some], q[at + j]), DIGITS) + 0.0
            good = np.flatnonzero(score >= floor[j] - SLACK)
            held[at + j] = sorted(held[at + j] + list(zip((-score[good]).tolist(), ids[some[good]].tolist(), strict=True)))[:k]
    return worked


def blocks(rows: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, q = [], []
    most = max(1, QUERY_BYTES // (8 * size))
    for r in rows.toLocalIterator():
        ids.append(r["id"])
        q.append(np.pad(r["unit"], (0, size - len(r["unit"]))))
        if len(ids) == most:
            yield np.array(ids), np.array(q)
            ids, q = [], []
    if ids:
        yield np.array(ids), np.array(q)


def cosine_top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", worked=None) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where `is_query` (of the column `id`) holds, the k rows of largest cosine.

    Scores are rounded to DIGITS digits, and ties go to the smaller id. Rows without an id or a direction take no part; shorter vectors count as
    filled up with zeros. Rows that repeat an id are candidates of their own, and no candidate for a query of that id; repeated
    queries are one. Queries are broadcast in blocks of QUERY_BYTES. `worked` is an accumulator for the pairs multiplied out. An
    empty table has no result; other columns are ignored.
    """
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows = kept(units(vectors, id_col, vector_col), "units")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], schema)
    size = rows.agg(F.max(F.size("unit"))).first()[0]
    seen = np.array([np.pad(r["unit"], (0, size - len(r["unit"]))) for r in sample])
    axes = np.linalg.eigh(seen.T @ seen)[1][:, ::-1].copy()
    rest = sum((F.aggregate(F.zip_with("unit", F.lit([float(a) for a in axes[:, i]]), lambda x, a: F.coalesce(x * a, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x) ** 2 for i in range(min(HEAD, size))), F.lit(0.0))
    rows = kept(rows.withColumn("near", rest).repartitionByRange(F.col("near").desc()).sortWithinPartitions(F.col("near").desc()).drop("near"), "ordered")
    sample_ids, out = np.array([r["id"] for r in sample]), []
    for queries, q in blocks(rows.where(is_query).dropDuplicates(["id"]), size):
        turned = Turned(q, axes)
        first: list[list] = [[] for _ in queries]
        best(sample_ids, seen, axes, queries, q, turned, first, k)
        # The k-th of the sample is reached by k rows, so lower scores need not leave a task.
        seed = np.array([-h[-1][0] if len(h) == k else -2.0 for h in first])

        def search(batches, queries=queries, q=q, turned=turned, seed=seed):
            held = [[(-s, np.iinfo(np.int64).max)] * k if s > -2 else [] for s in seed.tolist()]
            for batch in batches:
                for at in range(0, batch.num_rows, TOGETHER):
                    part = batch.slice(at, TOGETHER)
                    n = best(part.column("id").to_numpy(), matrix(part.column("unit"), size), axes, queries, q, turned, held, k)
                    if worked is not None:
                        worked.add(n)
            found = [(x, i, -s) for x, h in zip(queries.tolist(), held, strict=True) for s, i in h if i != np.iinfo(np.int64).max]
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

        found = rows.mapInArrow(search, "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        out.append(kept(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score"), "cosines"))
    whole = out[0] if out else spark.createDataFrame([], schema)
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
