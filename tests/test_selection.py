"""Contamination, quantiles, evaluation and time joins against plain definitions, with nulls, ties and hot keys."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import evaluation
from weftline.operators.contamination import shared_runs
from weftline.operators.joins import as_of, soon_after
from weftline.operators.order import before
from weftline.operators.quantiles import quantile
from weftline.plans import catalogue

START = dt.datetime(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def runs(text, run):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return w, [tuple(w[i : i + run]) for i in range(len(w) - run + 1)]


def contaminated(docs, items, run):
    out = {}
    for doc_id, text in docs:
        for item_id, item in items:
            w, own = runs(item, run)
            mine = set(runs(text, run)[1])
            at = [i for i, r in enumerate(own) if r in mine]
            covered = {i + k for i in at for k in range(run)}
            if at:
                passages = 1 + sum(b - a > run for a, b in zip(at, at[1:]))
                out[doc_id, item_id] = (len({own[i] for i in at}), len(covered), len(w), round(len(covered) / len(w), 6), passages)
    return out


@pytest.mark.parametrize(("run", "most_words"), [(8, 1 << 21), (8, 0), (3, 1 << 21), (1, 1 << 21), (5, 64)])
def test_contamination_like_brute_force(spark, run, most_words):
    draw = np.random.default_rng(4)
    word = lambda n: " ".join(draw.choice(["der", "Straße", "日本", "año", "x1", "Ελλάδα", "и", "the"], int(n)))
    items = [(i, word(draw.integers(0, 40))) for i in range(12)] + [(20, None), (21, ""), (22, "a a a a a a a a a a a a")]
    docs = [(i, word(draw.integers(0, 90))) for i in range(40)] + [(50 + i, f"{word(9)} -- {items[i][1].upper()}!\n{word(3)} {items[i + 1][1]}") for i in range(10)]
    docs += [(70, None), (71, ""), (72, "a, " * 9), (73, "a " * 30000)]
    found = shared_runs(spark.createDataFrame([(*d, "w") for d in docs], "doc_id long, text string, run string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), run=run, most_words=most_words)
    assert {(r.doc_id, r.item_id): (r.shared, r.covered, r.item_words, r.share, r.passages) for r in found.collect()} == contaminated(docs, items, run)


def test_contamination_filters_before_it_shuffles(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    plan = plan_of(shared_runs(docs, docs.withColumnRenamed("doc_id", "item_id")))
    assert re.search(r"Filter \(isnotnull\(r#\d+\.h\) AND \(\(Subquery", plan) and "SortMergeJoin [doc_id" not in plan
    texts = plan[plan.index("BroadcastHashJoin [doc_id") :]  # the documents come straight from their scan
    assert "LeftSemi" in texts[:80] and "Exchange" not in texts[: texts.index("Scan")]
    assert shared_runs(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_quantiles_with_ties_nulls_and_a_hot_group(spark):
    draw = np.random.default_rng(8)
    hot = np.round(draw.normal(0, 50, 20000)) + 0.5 * (draw.random(20000) < 0.5)
    rows = [("hot", float(x)) for x in hot] + [("tie", 7.0)] * 3000 + [("two", 1.0), ("two", 2.0), ("none", None), (None, 4.0), (None, 9.0), ("nan", float("nan")), ("nan", -0.0), ("wild", 1e300), ("wild", -1e300), ("wild", 1.0)]
    df = spark.createDataFrame([(g, x, "a") for g, x in rows], "g string, v double, n string").repartition(6)
    for p in (0.0, 0.25, 0.5, 0.987, 1.0):
        for reach in (0.01, 0.00001, 0.9):
            got = {r["g"]: (r["n"], r["quantile"]) for r in quantile(df, "g", "v", p, reach).collect()}
            for g in {g for g, _ in rows}:
                own = [x for h, x in rows if h == g and x is not None and x == x]
                wanted = np.quantile(own, p) if own else None
                assert got[g][0] == len(own)
                assert got[g][1] == wanted or abs(got[g][1] - wanted) <= 1e-9 * abs(wanted), (g, p, reach)
            if p != 0.5:
                break
    assert quantile(df.limit(0), "g", "v", 0.5).count() == 0


def test_no_task_holds_a_group_of_a_quantile(spark):
    plan = plan_of(catalogue.queries()["p28_exact_quantile"](spark, "/root/testdata/sf0.001"))
    assert "percentile(" not in plan and "SinglePartition" not in plan


def auc_of(pos, neg):
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_evaluation_with_ties_and_odd_rows(spark):
    draw = np.random.default_rng(6)
    rows = [(float(np.round(x, 1)), int(draw.random() < x)) for x in draw.random(600)] + [(0.5, 1)] * 300
    odd = [(None, 1), (float("nan"), 0), (0.3, None), (0.4, 2), (-0.0, 0), (0.0, 1), (7.0, 1), (-3.0, 0)]
    df = spark.createDataFrame(rows + odd, "s double, y int").repartition(5)
    kept = rows + odd[4:]
    pos, neg = [s for s, y in kept if y], [s for s, y in kept if not y]
    got = evaluation.areas(df, "s", "y").first()
    assert (got.positives, got.negatives) == (len(pos), len(neg)) and abs(got.auc - auc_of(pos, neg)) < 1e-12
    points = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in evaluation.curve(df, "s", "y").collect()}
    assert points == {t: (sum(s >= t for s in pos), sum(s >= t for s in neg), sum(s < t for s in pos), sum(s < t for s in neg)) for t in {s for s, _ in kept}}
    bins = evaluation.calibration(df, "s", "y").collect()
    assert sum(r.n for r in bins) == len(kept) and {r.bin for r in bins} <= set(range(10))
    for found in (evaluation.curve(df, "s", "y"), evaluation.areas(df, "s", "y")):
        plan = plan_of(found)
        assert not re.search(r"Window .*\n.*Sort.*\n.*SinglePartition", plan)
    one = evaluation.areas(df.where("y = 1"), "s", "y").first()
    assert one.auc is None and one.average_precision == 1.0
    none = evaluation.areas(df.limit(0), "s", "y").first()
    assert (none.positives, none.auc, none.average_precision) == (0, None, None) and evaluation.curve(df.limit(0), "s", "y").count() == 0


def test_prefix_sums_over_ranges(spark):
    df = spark.range(5000).select(F.expr("(id * 7919) % 5000").alias("k"), F.expr("IF(id % 10 = 0, NULL, id)").alias("v")).repartition(9)
    rows = before(df, [F.col("k")], {"ahead": F.lit(1), "sum_ahead": F.col("v")}, parts=13).orderBy("k").collect()
    total = 0
    for i, r in enumerate(rows):
        assert (r.k, r.ahead, r.sum_ahead) == (i, i, total)
        total += r.v or 0
    with pytest.raises(ValueError):
        before(df, [F.col("k")], {"V": F.lit(1)})


def test_as_of_keeps_columns_of_any_name(spark):
    facts = spark.createDataFrame([(1, START, 5)], "k long, time timestamp_ntz, v long")
    probes = spark.createDataFrame([(1, START, 99, "r", "p", 1)], "k long, time timestamp_ntz, v long, row string, probe string, near int")
    with pytest.raises(ValueError):
        as_of(probes, facts, "k", "time", "v")
    out = as_of(probes, facts, "k", "time", "v", name="found")
    assert out.columns == [*probes.columns, "found"] and out.first() == (1, START, 99, "r", "p", 1, 5)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_interval_join_of_a_hot_key(spark, kind):
    draw = np.random.default_rng(12)
    row = lambda i: (int(i), 1 if i % 10 else int(i % 7), START + dt.timedelta(seconds=int(draw.integers(-40000, 40000))), "t1")
    a, b = [row(i) for i in range(900)], [row(i) for i in range(900)]
    a += [(1000, None, START, "x"), (1001, 1, None, "x"), (1002, 1, START, "x"), (1002, 1, START, "x")]
    b += [(1000, None, START, "x"), (1001, 1, None, "x"), (1002, 1, START, "x"), (1003, 1, START + dt.timedelta(seconds=300), "x"), (1004, 1, START + dt.timedelta(seconds=300, microseconds=1), "x")]
    left, right = (spark.createDataFrame(x, f"id long, k long, ts {kind}, t1 string") for x in (a, b))
    found = soon_after(left, right, "k", "ts", 300)
    span = dt.timedelta(seconds=300)
    wanted = sorted((x[0], y[0]) for x in a for y in b if x[1] is not None and x[1] == y[1] and x[2] and y[2] and x[2] < y[2] <= x[2] + span)
    assert sorted((r.first.id, r.then.id) for r in found.collect()) == wanted
    spread = found.hint("merge").repartition(8, "first.k")  # the join itself deals by key and bucket
    assert "t2" in plan_of(spread) and re.search(r"hashpartitioning\(k1#\d+L, b1#\d+L", plan_of(soon_after(left.hint("merge"), right, "k", "ts", 300)))
    assert soon_after(left.limit(0), right, "k", "ts", 300).count() == 0
