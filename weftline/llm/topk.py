"""Exact top-k inner-product search by block-at-a-time pruning over quantised vectors.

A component x becomes floor(64 x); a dimension is a term. Candidates are ordered by the nearest of a bounded sample of
vectors, so that alike ones stand together, and cut into ranges. A task streams its range; a block of vectors has
its term maxima and minima and a forward index (the block's matrix). For each query the blocks at hand are visited by
descending bound, summed from the term maxima (minima where the query is negative), until the bound falls below the
k-th score, which is carried from block to block and starts from the k-th among the sampled vectors.
Queries go to all tasks in blocks of a bounded number of bytes, one job a block; candidates are never replicated.

Rows without an id and vectors that are null or hold null or non-finite components take no part; shorter
vectors count as filled up with zeros. Components and scores beyond 64 bits end at the largest or smallest such number. Every other row is a candidate, also where rows repeat an id, and every such row
for which the query condition holds is a query, which meets all rows but itself. Ties go to the smaller id. An empty table has
no result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.anchors import parted, steps
from weftline.llm.common import discard, materialize, quoted

BLOCK = 128
#: Below this, sums of products are exact in double precision.
EXACT = 2**53
LOWEST = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", levels: int = 64) -> DataFrame:
    """(vec_id, v) of every row that takes part, with the vector in integers."""
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(whole)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * levels)).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
    n = np.diff(offsets)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), steps(n)] = flat
    return out


def whole(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; those beyond end at the largest or smallest that counts."""
    return (np.clip(scores, LOWEST + 1, LAST) if scores.dtype == object else scores).astype(np.int64)


class Search:
    """The k best candidates so far of each query: scores, ids and rows; `visited` of `blocks` bounds were scored."""

    def __init__(self, rows: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        self.rows, self.k = rows, k
        self.largest = max(1, -int(queries.min(initial=0)), int(queries.max(initial=0)))
        self.exact, self.quick = queries, queries.astype(np.float64)
        self.best, self.who = np.full((len(rows), k), LOWEST), np.full((len(rows), k), LAST)
        self.floor = floor  # no score below this one can be among the k best
        self.visited = self.blocks = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, block: int = BLOCK) -> None:
        """Meet some more candidates."""
        if not len(rows) or not len(self.rows):
            return
        most = self.largest * max(1, -int(vectors.min(initial=0)), int(vectors.max(initial=0))) * vectors.shape[1]
        kind = np.float64 if most < EXACT else np.int64 if most < LAST else object  # exact in each of them
        queries, vectors = self.quick if kind is np.float64 else self.exact.astype(kind), vectors.astype(kind)
        starts = np.arange(0, len(ids), block)
        most, least = np.maximum.reduceat(vectors, starts), np.minimum.reduceat(vectors, starts)
        bound = (np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T)
        bound = whole(bound)
        order = np.argsort(-bound, axis=1, kind="stable")
        self.blocks += bound.size
        for turn in range(len(starts)):
            visit = order[:, turn]
            active = np.flatnonzero(bound[np.arange(len(queries)), visit] >= np.maximum(self.best[:, -1], self.floor))
            if not len(active):
                break
            self.visited += len(active)
            for number, places in parted(visit[active]):
                part, at = active[places], starts[number]
                score = whole(queries[part] @ vectors[at : at + block].T)
                score[rows[at : at + block][None, :] == self.rows[part][:, None]] = LOWEST
                limit = np.maximum(self.best[part, -1], self.floor[part])
                useful = np.flatnonzero((score >= limit[:, None]).any(axis=1))
                mine, own = part[useful], ids[at : at + block]
                scores = np.hstack([self.best[mine], score[useful]])
                whose = np.hstack([self.who[mine], np.broadcast_to(own, (len(mine), len(own)))])
                pick = np.lexsort((whose, ~scores), axis=1)[:, : self.k]
                self.best[mine], self.who[mine] = np.take_along_axis(scores, pick, 1), np.take_along_axis(whose, pick, 1)


def top_k(vectors: DataFrame, is_query, k: int = 20, query_bytes: int = 16_000_000, sample: int = 1024, range_rows: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every row for which `is_query` holds.

    `query_bytes` bounds what is sent to every task at once, `sample` the vectors that order the candidates.
    """
    spark = vectors.sparkSession
    rows = materialize(quantised(vectors).withColumn("row", F.monotonically_increasing_id()), "topk")
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(F.size("v")).alias("w")).first()
    width = max(1, sizes["w"] or 0)
    blocks = max(1, -(-sizes["q"] * width * 8 // query_bytes))
    picked = rows.orderBy(F.xxhash64("row"), "row").limit(max(1, min(sample, query_bytes // (8 * width)))).toArrow().combine_chunks()
    picked_rows = picked["row"].to_numpy()
    centres = matrix(picked["v"].combine_chunks(), width) if len(picked_rows) else np.zeros((1, width), np.int64)
    centre_norms = (centres.astype(np.float64) ** 2).sum(1) / 2
    shared = spark.sparkContext.broadcast((picked_rows, centres, centre_norms))

    def place(batches):
        _, centres, norms = shared.value
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            for at in range(0, batch.num_rows, 2048):
                x = matrix(batch.column("v").slice(at, 2048), width).astype(np.float64)
                cell[at : at + 2048] = (x @ centres.T.astype(np.float64) - norms).argmax(axis=1) if len(x) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    def floors(batches):
        """Each query with the k-th score among the sampled vectors, its own row left out."""
        ids, centres, _ = shared.value
        for batch in batches:
            own, floor = batch.column("row").to_numpy(), np.full(batch.num_rows, LOWEST)
            for at in range(0, batch.num_rows, 2048):
                search = Search(own[at : at + 2048], matrix(batch.column("v").slice(at, 2048), width), floor[at : at + 2048], k)
                search.add(ids, np.arange(len(ids)), centres)
                floor[at : at + 2048] = search.best[:, -1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], [*batch.schema.names, "floor"])

    ranges = max(1, -(-sizes["n"] // range_rows))
    near = rows.mapInArrow(place, "vec_id long, v array<long>, row long, cell long")
    candidates = near.repartitionByRange(ranges, "cell", F.xxhash64("row")).sortWithinPartitions("cell") if ranges > 1 else near.coalesce(1).sortWithinPartitions("cell")
    if blocks > 1:
        candidates = materialize(candidates, "topk-candidates")
    asked = materialize(rows.where(is_query).mapInArrow(floors, "vec_id long, v array<long>, row long, floor long").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))), "topk-queries")

    def answers(block: int) -> DataFrame:
        some = asked.where(F.col("block") == block).orderBy("row").toArrow().combine_chunks()
        names = ("row", "vec_id", "floor")
        queries = spark.sparkContext.broadcast((*(some[c].to_numpy() for c in names), matrix(some["v"].combine_chunks(), width) if some.num_rows else np.zeros((0, width), np.int64)))

        def find(batches):
            own, ids, floor, x = queries.value
            search = Search(own, x, floor, k)
            for batch in batches:
                search.add(batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), matrix(batch.column("v"), width))
            # What is below a query's floor is below k others of the sample.
            good = (search.best > LOWEST) & (search.best >= floor[:, None])
            columns = [np.repeat(own, k)[good.ravel()], np.repeat(ids, k)[good.ravel()], search.who[good], search.best[good]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["query_row", "query_id", "vec_id", "score"])

        return candidates.mapInArrow(find, "query_row long, query_id long, vec_id long, score long")

    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    out = None
    for block in range(blocks):
        best = answers(block).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            best = materialize(best, "topk-block")
        out = best if out is None else out.unionByName(best)
    if blocks > 1:
        discard(candidates)
    return out


def embedding_search(vectors: DataFrame) -> DataFrame:
    """The 20 best candidates of every row whose id is divisible by 20."""
    return top_k(vectors, F.col("vec_id") % 20 == 0, 20)


ORACLE = """
WITH one AS (
    SELECT row_number() OVER () AS row, vec_id, embedding AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT row, vec_id, list_transform(e, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM one),
s AS (
    SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
