"""What shows only on larger tables: estimates, growth of memory and shuffles, evenly dealt work."""

import itertools
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.operators import evaluation, joins
from weftline.operators.contamination import run_counts
from weftline.operators.joins import theta
from weftline.operators.similarity import Turned, best
from weftline.plans import catalogue
from weftline.streaming import events


def test_estimate_of_many_distinct_values_is_close(spark, tmp_path):
    rows = spark.range(1_200_000).select(F.lit("A").alias("l_returnflag"), F.col("id").alias("l_partkey"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert list(map(tuple, catalogue.queries()["p31_approximate_distinct"](spark, str(tmp_path)).collect())) == [("A", 1_200_000, True)]


def test_a_group_has_one_sketch_not_one_for_each_value(spark, tmp_path):
    rows = [("A", 1), ("A", 1), ("A", None), ("B", 2), ("B", 3), (None, 4), (None, 4), (None, 5), ("C", None)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalogue.queries()["p31_approximate_distinct"](spark, str(tmp_path))
    assert set(map(tuple, found.collect())) == {("A", 1, True), ("B", 2, True), (None, 2, True), ("C", 0, True)}
    sketches = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "approx_count_distinct" in line and "Aggregate" in line]
    assert sketches and not any("l_partkey" in line[line.index("keys=[") : line.index("]")] for line in sketches)


@pytest.mark.parametrize("most", [1000, 10])
def test_theta_join_is_dealt_evenly(spark, most):
    a = spark.range(400).select(F.col("id").alias("a"), F.when(F.col("id") > 3, F.col("id") % 2).alias("k"), (F.col("id") % 50).alias("x")).coalesce(1)
    b = spark.range(60).select(F.col("id").alias("b"), (F.col("id") % 2).alias("l"), F.when(F.col("id") != 7, F.col("id")).alias("y")).coalesce(1)
    pairs = theta(a, b, F.col("x") < F.col("y"), ("k", "l"), most)
    assert pairs.columns == ["a", "k", "x", "b", "l", "y"]
    want = sorted((i, j) for i in range(4, 400) for j in range(60) if i % 2 == j % 2 and j != 7 and i % 50 < j)
    assert sorted((r.a, r.b) for r in pairs.collect()) == want
    sizes = [r["n"] for r in pairs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < len(want) / 2  # two keys in one file, yet no task has half of the pairs


def test_customers_of_one_file_are_dealt_to_all_tasks(spark):
    plan = catalogue.queries()["p13_theta_equi_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("by", ["y", None])
def test_theta_join_in_blocks_finds_each_pair_once(spark, monkeypatch, by):
    monkeypatch.setattr(joins, "BLOCK", 8)
    a = [(i % 90, None if i < 4 else i % 3, None if i == 9 else float(i % 50)) for i in range(200)]  # rows that repeat ids and whole rows too
    b = [(j, None if j == 5 else j % 4, None if j == 7 else float(j // 2)) for j in range(100)] + [(1, 1, 0.5)] * 20
    many, few = spark.createDataFrame(a, "a long, k int, x double").coalesce(1), spark.createDataFrame(b, "b long, l int, y double")
    pairs = theta(many, few, F.col("x") < F.col("y"), ("k", "l"), 10, by)
    assert pairs.columns == ["a", "k", "x", "b", "l", "y"]
    want = [r + s for r in a for s in b if None not in (r[1], r[2], s[2]) and r[1] == s[1] and r[2] < s[2]]
    assert sorted(map(tuple, pairs.collect())) == sorted(want)


def test_pairs_of_many_suppliers_take_little_room(spark, tmp_path):
    nation, balance = F.lit(3).alias("c_nationkey"), (F.xxhash64("id") % 10_000).cast("double")
    spark.range(1000).select(F.col("id").alias("c_custkey"), nation, balance.alias("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(12_000).select(F.col("id").alias("s_suppkey"), nation.alias("s_nationkey"), (-balance).alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{tmp_path}/customer.parquet").createOrReplaceTempView("customer_")
    spark.read.parquet(f"{tmp_path}/supplier.parquet").createOrReplaceTempView("supplier_")
    catalogue.queries()["p13_theta_equi_join"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/pairs")
    found, sums = spark.read.parquet(f"{tmp_path}/pairs"), (F.count("*"), F.sum("c_custkey"), F.sum("s_suppkey"), F.sum(F.col("c_custkey") * F.col("s_suppkey")))
    want = spark.sql("SELECT c_custkey, s_suppkey FROM customer_ JOIN supplier_ ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal")
    assert found.agg(*sums).collect() == want.agg(*sums).collect()
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.7 * found.count()  # bytes; all matches of a row at once took over 1.5 a pair


@pytest.mark.parametrize("most_words", [1 << 21, 0])
def test_shared_runs_count_once_null_ids_too(spark, most_words):
    docs = spark.createDataFrame([(1, "A b, c d"), (1, "b c d e"), (None, "a b c"), (None, "b c d"), (2, None), (3, "a b x c"), (4, " b c")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d"), (7, "b c d"), (None, "b c d e"), (8, "; b c;"), (9, None)], "item_id long, text string")
    found = run_counts(docs, items, lambda text: F.split(F.lower(text), "[^a-z0-9]+"), 3, most_words)
    assert set(map(tuple, found.collect())) == {(1, 7, 2), (1, None, 2), (None, 7, 2), (None, None, 1), (4, 8, 1)}


def test_word_runs_are_tested_before_they_are_shuffled(spark):
    plan = catalogue.queries()["p92_shared_word_runs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    texts = plan[plan.index("HashAggregate(keys=[doc_id") :]
    assert "Subquery" in texts and "SortMergeJoin [g" not in plan


class Held:
    """State of one user in memory; every call counts, as each is a round trip to the JVM."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, set()

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def call(self, result=None):
        self.calls += 1
        return result

    def get(self):
        return self.call(self.value)

    def update(self, value):
        self.value = self.call(value)

    def registerTimer(self, at):
        self.timers.add(self.call(at))

    def deleteTimer(self, at):
        self.timers.remove(self.call(at))

    def iterator(self):
        return self.call(iter(list(self.map.items())))

    def updateValue(self, key, value):
        self.map[key] = self.call(value)


def test_a_batch_of_visits_is_one_frame_and_few_calls():
    draw = np.random.default_rng(3)
    for _ in range(100):
        held, user, out = Held(), events.Visits(), []
        user.init(held)
        hours = draw.integers(0, 150, 12).tolist()
        if draw.random() < 0.5:
            hours.sort()
        for part in (hours[:4], hours[4:5], hours[5:]):  # batches in any order of time, while the visit is open
            calls = held.calls
            frames = list(user.handleInputRows((1,), iter([pd.DataFrame({"ts": pd.to_datetime(part, unit="h")})]), None))
            assert len(frames) <= 1 and held.calls - calls <= 4 and held.timers == {(held.value[1] + events.QUIET) // 1000}
            out += [tuple(r) for f in frames for r in f[["first", "last", "n"]].itertuples(index=False)]
        assert sum(n for *_, n in out) + held.value[2] == 12
        whole = sorted(hours)
        if hours[:5] == whole[:5]:
            cuts = [0, *(i for i in range(1, 12) if whole[i] - whole[i - 1] >= 12), 12]
            assert [n for *_, n in out] == [b - a for a, b in itertools.pairwise(cuts)][:-1]


def test_kinds_are_read_once_and_written_once():
    held, user = Held(), events.Kinds(1000)
    user.init(held)
    for i in (1, 2):
        calls = held.calls
        (frame,) = user.handleInputRows((1,), iter([pd.DataFrame({"event_type": ["a", "b", "a"]}), pd.DataFrame({"event_type": ["c", "a"]})]), None)
        assert frame.to_dict("records") == [{"user_id": 1, "kinds": 3, "n": 5 * i}] and held.calls - calls <= 4


def test_kinds_of_a_bucket_of_users_are_one_frame_and_one_read():
    held, bucket, users = Held(), events.Kinds(1000), [*range(100), 2**53 + 1]
    bucket.init(held)
    for i in (1, 2):
        calls = held.calls
        rows = pd.DataFrame([(u, kind) for kind in "aab" for u in users if u or kind == "a"], columns=["user_id", "event_type"])
        (frame,) = bucket.handleInputRows((7,), iter([rows[:130], rows[130:]]), None)
        assert held.calls - calls == 1 + 2 * len(users) - 1
        assert frame.to_dict("records") == [{"user_id": u, "kinds": 2 if u else 1, "n": (3 if u else 2) * i} for u in users]
    (frame,) = bucket.handleInputRows((7,), iter([pd.DataFrame({"user_id": [3], "event_type": ["c"]})]), None)
    assert frame.to_dict("records") == [{"user_id": 3, "kinds": 3, "n": 7}]


def test_memory_of_cosines_does_not_grow_with_the_queries():
    draw = np.random.default_rng(5)
    x, q = (draw.standard_normal((n, 32)) for n in (1000, 6000))
    x, q = (v / np.sqrt((v * v).sum(axis=1))[:, None] for v in (x, q))
    axes, held = np.eye(32), [[] for _ in q]
    best(np.arange(1000), x, axes, np.arange(6000), q, Turned(q, axes), held, 3)
    want = np.round(x @ q.T, 9)
    want[np.arange(1000), np.arange(1000)] = -2
    assert all([i for _, i in held[j]] == np.lexsort((np.arange(1000), -want[:, j]))[:3].tolist() for j in range(0, 6000, 499))
    tracemalloc.start()
    best(np.arange(1000), x, axes, np.arange(6000), q, Turned(q, axes), [[(-1.1, 0)] * 3 for _ in q], 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000  # the bounds of all queries at once were 48 MB a table


@pytest.mark.parametrize("of", [evaluation.curve, evaluation.areas])
def test_scores_are_computed_once(spark, of):
    seen = spark.sparkContext.accumulator(0)

    def score(x):
        seen.add(1)
        return x % 7 / 7

    df = spark.range(100, numPartitions=2).select(F.udf(score, "double")("id").alias("score"), (F.col("id") % 2).alias("y"))
    assert of(df, "score", "y").collect() and seen.value == 100


def test_plain_characters_are_counted_by_runs(spark, tmp_path):
    texts = ["ab c", "", None, "1a2b", "äö\U0001f600x\n y", "\U0001f600", "ab" * 3000 + "."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(len(texts)) if i != 1], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = catalogue.scored(spark, str(tmp_path))
    share = lambda t: int(sum(c == " " or c.isascii() and c.isalpha() for c in t) * 100 / len(t) + 0.5) / 100
    assert {r.doc_id: r.score for r in found.collect()} == {i: None if t is None else share(t) for i, t in enumerate(texts) if i != 1}
    assert "[a-zA-Z ]+" in found._jdf.queryExecution().executedPlan().toString()
