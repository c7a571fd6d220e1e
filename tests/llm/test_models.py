"""The classifiers' arithmetic against plain loops, and odd values of the vector search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import quality, topk, toxicity
from weftline.llm.toxicity import FILTERS, SPANS, Network, Words


def test_trees_like_a_walk():
    draw = np.random.default_rng(1)
    x = np.round(draw.normal(size=(400, 6)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.grow(x, y, np.ones(len(y)), trees=12)
    inner = forest.feature.shape[1]

    def walk(row):
        raw = forest.base
        for feature, limit, leaf in zip(forest.feature, forest.limit, forest.leaf):
            node = 0
            while node < inner:
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            raw += leaf[node - inner]
        return 1 / (1 + np.exp(-raw))

    found = forest.score(x)
    assert np.allclose(found, [walk(r) for r in x], atol=1e-12)
    assert np.mean((found > 0.5) == y) > 0.95


TEXTS = ["alpha beta gamma beta", "", "delta", "beta beta alpha epsilon zeta eta theta alpha", "gamma " * 30]


def network():
    net, words = Network(), Words(most=1 << 30)
    draw = np.random.default_rng(4)
    net.vectors = draw.normal(size=net.vectors.shape).astype(np.float32) * 0.3
    net.bias = {k: (draw.normal(size=FILTERS) * 0.1).astype(np.float32) for k in SPANS}
    net.out = draw.normal(size=net.out.shape).astype(np.float32) * 0.2
    return net, words, *words.read(TEXTS)[:2]


def test_pooling_like_a_plain_convolution():
    net, words, rows, starts = network()
    found, _, _ = net.pooled(words.table, rows, starts)
    vector = lambda r: np.zeros(net.vectors.shape[1]) if r == 0 else net.vectors[words.table[r]].astype(np.float64).sum(axis=0)
    for text, (a, b) in enumerate(zip(starts, [*starts[1:], len(rows)])):
        v, wanted = [vector(r) for r in rows[a:b]], []
        for k in SPANS:
            each = [sum((v[i + o] @ net.filters[k][o].astype(np.float64) for o in range(k)), net.bias[k].astype(np.float64)) for i in range(len(v) - k + 1)]
            wanted.append(np.maximum(np.max(each, axis=0), 0))
        # Filters end with the text's own padding: its neighbours in a batch change nothing.
        assert np.allclose(found[text], np.concatenate(wanted), atol=1e-4)


def test_gradients_like_differences():
    """One Adagrad step of a parameter, solved for its gradient, against the difference of the mean log loss."""
    y = np.array([1, 0, 1, 0, 1], np.float32)
    net, words, rows, starts = network()
    texts = np.split(rows, starts[1:])

    def loss(n):
        pooled = n.pooled(words.table, rows, starts)[0].astype(np.float64)
        p = 1 / (1 + np.exp(-(pooled @ n.out.astype(np.float64) + float(n.base))))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    def slope(of, at, step=2e-3):
        up, down = network()[0], network()[0]
        of(up)[at] += step
        of(down)[at] -= step
        return (loss(up) - loss(down)) / (2 * step)

    trained = network()[0]
    trained.train(words.table, texts, y, 1, rate=0.1)
    for of, places in ((lambda n: n.out, [(0,), (3,), (-1,)]), (lambda n: n.filters[SPANS[0]], [(0, 0, 0), (0, 3, 1)]), (lambda n: n.filters[SPANS[-1]], [(1, 2, 0), (0, 1, 2)]), (lambda n: n.bias[SPANS[0]], [(0,), (2,)])):
        for at in places:
            moved = (float(of(net)[at]) - float(of(trained)[at])) / 0.1  # g / sqrt(0.001 + g^2)
            gradient = moved * np.sqrt(1e-3) / np.sqrt(max(1e-12, 1 - moved**2))
            assert gradient == pytest.approx(slope(of, at), rel=0.08, abs=2e-4)


def test_repeated_rows_and_long_texts_score_alike(spark):
    rows = [(i, "good words here " * (1 + i % 3), i % 2) for i in range(60)] + [(7, "good words here " * 2, 1)] * 3 + [(99, "word " * 60000, 0), (100, None, 0), (101, "", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[2]) for r in rows], "doc_id long, toxic int, quality int")
    for report in (toxicity.toxicity_report(docs, labels), quality.quality_report(docs, labels)):
        found = report.collect()
        assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
        assert len({r.score for r in found if r.doc_id == 7}) == 1 and len({r.score for r in found if r.doc_id >= 100}) == 1


def test_scores_beyond_64_bits_end_there(spark):
    vectors = [(0, [1e300, 1e300]), (1, [1.0, 1.0]), (2, [-1e300, 0.0]), (3, [1e300, 0.0]), (4, [0.5, 0.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = topk.top_k(df, F.col("vec_id") == 0, 4).orderBy("rank").collect()
    most = 2**63 - 1
    assert [(r.vec_id, r.score) for r in found] == [(1, most), (3, most), (4, most), (2, -most)]


def test_a_task_passes_on_nothing_below_the_floor(spark):
    draw = np.random.default_rng(2)
    df = spark.createDataFrame([(i, draw.normal(size=8).tolist()) for i in range(4000)], "vec_id long, embedding array<double>").repartition(4)
    found = topk.top_k(df, F.col("vec_id") % 200 == 0, 5, range_rows=250)
    x = df.orderBy("vec_id").collect()
    v = np.floor(64 * np.array([r.embedding for r in x])).astype(np.int64)
    for q in (0, 1800, 3800):
        score = v @ v[q]
        score[q] = -(2**62)
        wanted = sorted(zip((-score).tolist(), range(4000)))[:5]
        assert [(r.vec_id, r.score) for r in found.where(F.col("query_id") == q).orderBy("rank").collect()] == [(i, -s) for s, i in wanted]
    assert found.count() == 20 * 5
