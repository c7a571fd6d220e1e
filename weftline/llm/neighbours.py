"""Embedding near-dedup by NN-descent.

Equal vectors are one node. A first neighbour graph comes from a few tables of random-hyperplane codes; then, round
by round, every node introduces its neighbours (both ways) to each other, and each keeps the nearest. A list
holds KEEP neighbours; one that is saturated with links is enlarged to MOST, and keeps besides the STARS links of least hash, which
hold a dense group together. The number of tables follows the length of the codes, so that a pair at the limit is likely to share one.
After the lists settle, the components of their links are audited: nodes are compared with all vectors until LINKED nodes with links have
been seen or all nodes compared, and a link is found if both ends are in one component; what the audit misses joins the graph. While
recall is below the target, more tables are added, and after that all nodes are compared block by block. Links are then
counted within components, block by block, so a dense group costs rows in proportion to its size and to its number of blocks,
and no list of a node's links is ever stored. Similarities are computed in double precision from the vectors as they are.

Vectors that are null, zero or hold null or non-finite components link with nothing; vectors link
only with others of their length; rows without an id are dropped. Equal vectors link with each other. Of ties the smaller id goes
first. An empty table has no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.anchors import parted
from weftline.llm.common import discard, materialize, quoted
from weftline.llm.components import components

LINK = 0.9
KEEP, MOST, STARS, MEET = 6, 24, 2, 32  # neighbours of a list, of a saturated one, links of least hash; how many a node introduces in a round
TABLES, BUCKET, MISSED = 12, 64, 1e-3  # least number of tables; chance that a pair at the limit shares no code
TARGET, AUDITED, LINKED = 0.97, 400, 400
BLOCK, STRIP = 16_384, 512  # nodes of a block, and how many of them meet another block at once
NONE = -(2**63)
PART = 2048  # nodes of a component that are counted against as many others at once
EDGE = "u long, v long, sim double"


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks().flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def cosines(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1))
    return (x @ x.T) / (norm[:, None] * norm[None, :])


def edge_table(u, v, sim) -> pa.Table:
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float64())], ["u", "v", "sim"])


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, vec, copies) of the distinct vectors that can link."""
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.where(F.col("vec").isNotNull()).where(sound).groupBy("vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))


def code_bits(n: int) -> int:
    return max(1, round(np.log2(max(2, n / 24))))


def table_count(n: int) -> int:
    """Tables after which a pair at the limit has shared a code but for a chance of MISSED."""
    shared = (1 - np.arccos(LINK) / np.pi) ** code_bits(n)
    return max(TABLES, int(np.ceil(np.log(MISSED) / np.log1p(-shared))))


def first_graph(nodes: DataFrame, n: int, width: int, tables: range, seed: int = 5) -> DataFrame:
    """Edges between nodes that share a code, the nearest few of each in each table.

    A code that many nodes share is split at random into parts of bounded size.
    """
    bits = code_bits(n)

    def code(batches):
        planes = {t: np.random.default_rng((seed, t)).standard_normal((width, bits)) for t in tables}
        for batch in batches:
            x = matrix(pa.chunked_array([batch.column("vec")])) if batch.num_rows else np.zeros((0, width))
            for t in tables:
                own = ((x @ planes[t]) > 0) @ (1 << np.arange(bits)) + (t << 40)
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("vec"), pa.array(own.astype(np.int64))], ["node", "vec", "code"])

    def pairs(table: pa.Table) -> pa.Table:
        x, ids = matrix(table["vec"]), table["node"].to_numpy()
        code, part = table["code"].to_numpy(), table["part"].to_numpy()
        order = np.lexsort((ids, part, code))
        cut = np.flatnonzero((np.diff(code[order]) != 0) | (np.diff(part[order]) != 0)) + 1
        out = []
        for own in np.split(order, cut):
            if len(own) < 2:
                continue
            s = cosines(x[own])
            np.fill_diagonal(s, -2)
            # The nearest three, and links among the nearest MOST; the first in the part stands for the rest.
            k = min(MOST, len(own) - 1)
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            mark = np.zeros(s.shape, bool)
            np.put_along_axis(mark, near, True, 1)
            mark &= s >= LINK
            mark[:, 0] |= s[:, 0] >= LINK
            k = min(3, len(own) - 1)
            np.put_along_axis(mark, np.argpartition(-s, k - 1, axis=1)[:, :k], True, 1)
            a, b = np.nonzero(mark)
            out.append((ids[own[a]], ids[own[b]], s[a, b]))
        return edge_table(*map(np.concatenate, zip(*out, strict=True))) if out else edge_table([], [], [])

    coded = nodes.select("node", "vec").mapInArrow(code, nodes.select("node", "vec").schema.simpleString().removeprefix("struct<").removesuffix(">") + ",code:bigint")
    sizes = coded.groupBy("code").agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / (4 * BUCKET)).cast("long"))
    dealt = coded.join(sizes, "code").withColumn("part", F.pmod(F.xxhash64("node", "code"), F.col("parts"))).drop("size", "parts")
    shards = max(1, n * len(tables) // 20_000)
    return dealt.withColumn("shard", F.pmod(F.xxhash64("code", "part"), F.lit(shards))).groupBy("shard").applyInArrow(pairs, EDGE)


def nearest(edges: DataFrame) -> DataFrame:
    """The list of each node: its nearest KEEP, MOST where all are links, and the STARS links of least hash."""
    best = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    by_sim, by_hash = (Window.partitionBy("u").orderBy(*o) for o in ((F.col("sim").desc(), "v"), ((F.col("sim") < LINK), F.xxhash64("v"), "v")))
    ranked = best.withColumn("nth", F.row_number().over(by_sim)).withColumn("star", F.row_number().over(by_hash))
    link = F.col("sim") >= LINK
    return ranked.where((F.col("nth") <= KEEP) | (link & ((F.col("nth") <= MOST) | (F.col("star") <= STARS)))).drop("nth", "star")


def introduce(graph: DataFrame, nodes: DataFrame, n: int, turn: int) -> DataFrame:
    """Edges found by comparing the neighbours of each node with each other."""
    both = graph.select(F.col("u").alias("w"), F.col("v").alias("node"), "sim").union(graph.select("v", "u", "sim"))
    # Neighbours are met in another order in each round, so that large groups close.
    order = Window.partitionBy("w").orderBy(F.xxhash64("w", "node", F.lit(turn)), "node")
    met = both.groupBy("w", "node").agg(F.max("sim").alias("sim")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= MEET)
    # What a list still takes: anything while it is short, links until it is enlarged, then what is nearer than its last.
    last, size = F.min("sim"), F.count("*")
    limit = F.when(size < KEEP, -2.0).when((last >= LINK) & (size < MOST), LINK - 1e-9).otherwise(last)
    weakest = graph.groupBy(F.col("u").alias("node")).agg(limit.alias("weakest"))
    ready = nodes.select("node", "vec").join(weakest, "node", "left").withColumn("weakest", F.coalesce("weakest", F.lit(-2.0)))
    shards = max(1, n // 2000)
    rows = met.select("w", "node").join(ready, "node").withColumn("shard", F.pmod(F.xxhash64("w"), F.lit(shards)))

    def meet(table: pa.Table) -> pa.Table:
        x, ids, w, weak = matrix(table["vec"]), table["node"].to_numpy(), table["w"].to_numpy(), table["weakest"].to_numpy()
        order, out = np.lexsort((ids, w)), []
        for own in np.split(order, np.flatnonzero(np.diff(w[order])) + 1):
            if len(own) > 1:
                s = cosines(x[own])
                useful = s > weak[own][:, None]
                np.fill_diagonal(useful, False)
                a, b = np.nonzero(useful)
                out.append((ids[own[a]], ids[own[b]], s[a, b]))
        return edge_table(*map(np.concatenate, zip(*out, strict=True))) if out else edge_table([], [], [])

    return rows.groupBy("shard").applyInArrow(meet, EDGE)


def audited_links(some: DataFrame, nodes: DataFrame, n_some: int, n: int) -> DataFrame:
    """(u, v, links, found): of `some` nodes, compared with all nodes block by block, how many links they have and how many
    of them lead to their own label; and rows with a `v`, one link to each other label in a block. Nodes have labels."""
    size = min(BLOCK, max(STRIP, n // 8))
    rows, columns = -(-n_some // size), -(-n // size)
    left = some.select("node", "vec", "label", F.pmod(F.xxhash64("node"), F.lit(rows)).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("q"))
    right = nodes.select("node", "vec", "label", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("p"), F.pmod(F.xxhash64("node"), F.lit(columns)).cast("int").alias("q"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros((0, 4), np.int64)]
        if left.num_rows and right.num_rows:
            x, y = matrix(left["vec"]), matrix(right["vec"])
            (ids, own), (others, theirs) = ((t["node"].to_numpy(), t["label"].to_numpy()) for t in (left, right))
            norm = np.sqrt((y * y).sum(1))
            for at in range(0, len(x), STRIP):
                part = x[at : at + STRIP]
                s = (part @ y.T) / (np.sqrt((part * part).sum(1))[:, None] * norm[None, :])
                mark = (s >= LINK) & (ids[at : at + STRIP, None] != others[None, :])
                same = mark & (own[at : at + STRIP, None] == theirs[None, :])
                some_, total = np.flatnonzero(mark.any(axis=1)), mark.sum(axis=1)
                out.append(np.stack([ids[at + some_], np.full(len(some_), NONE), total[some_], same.sum(axis=1)[some_]], axis=1))
                a, b = np.nonzero(mark & ~same)
                _, one = np.unique(np.stack([a, theirs[b]], axis=1), axis=0, return_index=True)
                out.append(np.stack([ids[at + a[one]], others[b[one]], np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)], axis=1))
        return pa.table(list(map(pa.array, np.concatenate(out).T.copy())), ["u", "v", "links", "found"])

    return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(compare, "u long, v long, links long, found long")


def audit(labelled: DataFrame, n: int) -> tuple[float, DataFrame, bool]:
    """Recall of the components over audited nodes, links between components, and whether all nodes were audited.

    Nodes are added until LINKED of them have links. Recall is the lesser of the share of links found and of the mean of
    this share over linked nodes, so that large groups of links do not hide what single pairs lose.
    """
    audited = min(n, AUDITED)
    while True:
        some = labelled if audited == n else labelled.orderBy(F.xxhash64("node"), "node").limit(audited)
        true = materialize(audited_links(some, labelled, audited, n), "audit")
        share = true.where(F.col("v") == NONE).groupBy("u").agg(F.sum("links").alias("n"), F.sum("found").alias("found"))
        seen = share.agg(F.count("*").alias("linked"), F.sum("n").alias("n"), F.sum("found").alias("found"), F.avg(F.col("found") / F.col("n")).alias("mean")).first()
        if audited == n or seen["linked"] >= LINKED:
            recall = min(seen["found"] / seen["n"], seen["mean"]) if seen["linked"] else 1.0
            return recall, true.where(F.col("v") != NONE).select(F.col("u").alias("a"), F.col("v").alias("b")), audited == n
        discard(true)
        # As many as the links seen let expect, and half as many again.
        audited = min(n, max(2 * audited, 3 * audited * LINKED // (2 * max(1, seen["linked"]))))


def with_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, vec, copies, label) of all nodes; one that has no link is its own label."""
    return materialize(nodes.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")


def linked_nodes(nodes: DataFrame, n: int, width: int) -> DataFrame:
    """Nodes with the labels of their components, in which at least TARGET of all links lie, as audited; all, where every node was compared."""
    least = tables = table_count(n)
    graph, more, turn, new = None, None, 0, range(least)
    while True:
        edges = first_graph(nodes, n, width, new)
        graph = materialize(nearest(edges if graph is None else graph.unionByName(edges)), "graph")
        while True:
            turn += 1
            before, graph = graph, materialize(nearest(graph.unionByName(introduce(graph, nodes, n, turn))), "graph")
            fresh = graph.join(before, ["u", "v"], "left_anti").count()
            discard(before)
            if fresh <= 0.01 * KEEP * n:
                break
        links = graph.where(F.col("sim") >= LINK).select(F.col("u").alias("a"), F.col("v").alias("b"))
        labelled = with_labels(nodes, links if more is None else links.unionByName(more))
        recall, missed, whole = audit(labelled, n)
        if recall < TARGET and not whole and tables >= 8 * least:
            missed, whole = materialize(audited_links(labelled, labelled, n, n), "links-all").where(F.col("v") != NONE).select(F.col("u").alias("a"), F.col("v").alias("b")), True
        more = missed if more is None else more.unionByName(missed)
        if whole or recall >= TARGET:
            return labelled if missed.isEmpty() else with_labels(nodes, links.unionByName(more))
        new = range(tables, 2 * tables)
        tables *= 2


def link_counts(labelled: DataFrame, shard_rows: int = 20_000) -> DataFrame:
    """(node, near): how many vectors of its component each node links with, copies counted, its own left out.

    Small components are counted many at a time; a large one is cut into parts, of which each pair is a group.
    """
    sizes = labelled.groupBy("label").agg(F.count("*").alias("size")).where("size > 1").withColumn("parts", F.ceil(F.col("size") / PART))
    rows = labelled.join(sizes, "label").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    total = sizes.where("parts = 1").agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_rows))
    small = rows.where("parts = 1").withColumn("k", F.pmod(F.xxhash64("label"), F.lit(shards))).withColumn("p", F.lit(0).cast("long")).withColumn("q", F.lit(-1).cast("long"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    large = rows.where("parts > 1").withColumn("k", F.col("label")).withColumn("other", other).withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other"))
    columns = (F.size("vec").alias("width"), "k", "p", "q", "label", "part", "node", "vec", "copies")

    def count(table: pa.Table) -> pa.Table:
        x, copies, node = matrix(table["vec"]), table["copies"].to_numpy(), table["node"].to_numpy()
        near = np.zeros(len(node), np.int64)
        norm = np.sqrt((x * x).sum(1))
        whole = table["q"][0].as_py() < 0

        def meet(rows: np.ndarray, others: np.ndarray) -> None:
            for at in range(0, len(rows), STRIP):
                own = rows[at : at + STRIP]
                s = (x[own] @ x[others].T) / (norm[own][:, None] * norm[others][None, :])
                near[own] += ((s >= LINK) & (node[own][:, None] != node[others][None, :])) @ copies[others]

        if whole:
            for _, own in parted(table["label"].to_numpy()):
                meet(own, own)
        elif table["p"][0].as_py() == table["q"][0].as_py():
            meet(np.arange(len(node)), np.arange(len(node)))
        else:
            both = [own for _, own in parted(table["part"].to_numpy())]
            if len(both) == 2:
                meet(*both)
                meet(*both[::-1])
        return pa.table({"node": node, "near": near})

    found = small.select(*columns).unionByName(large.select(*columns)).groupBy("width", "k", "p", "q").applyInArrow(count, "node long, near long")
    return found.groupBy("node").agg(F.sum("near").alias("near"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    rows = vectors.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).alias("vec")).where(F.col("vec_id").isNotNull())
    nodes = materialize(nodes_of(rows), "vectors")
    found = nodes.limit(0).withColumn("label", F.lit(0).cast("long"))
    for width, n in sorted(map(tuple, nodes.groupBy(F.size("vec")).count().collect())):
        if n > 1:
            found = found.unionByName(linked_nodes(nodes.where(F.size("vec") == width), n, width))
    labels = materialize(found.select("node", "label").join(link_counts(found), "node", "left"), "links")
    joined = nodes.join(labels, "node", "left").select("vec", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("label", "node").alias("label"))
    label = F.coalesce("label", "vec_id")
    return rows.join(joined, "vec", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), label.alias("component_id"), (F.col("vec_id") == label).alias("kept"))
