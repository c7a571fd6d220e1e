"""Hand-made rows for what the tables do not show: nulls, ties, unmatched keys, late and repeated events, plans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline.operators.joins import as_of
from weftline.plans import catalogue
from weftline.sources.tables import scratch
from weftline.streaming import events

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_as_of_with_ties_nulls_and_many_buckets(spark):
    facts = [(1, at(0), 10), (1, at(0), 12), (1, at(3000), 13), (2, at(5), 20), (None, at(1), 30), (1, None, 40), (1, at(1), None)]
    probes = [(100, 1, at(0)), (101, 1, at(2)), (102, 1, at(2999)), (103, 1, at(9000)), (104, 2, at(4)), (105, 3, at(9)), (106, None, at(9)), (107, 1, None), (108, 2, at(5))]
    facts = spark.createDataFrame(facts, "k long, ts timestamp_ntz, v long")
    probes = spark.createDataFrame(probes, "id long, k long, ts timestamp_ntz")
    wanted = {100: 12, 101: 12, 102: 12, 103: 13, 104: None, 105: None, 106: None, 107: None, 108: 20}
    for bucket in ("minute", "day", "year"):
        assert {r.id: r.v for r in as_of(probes, facts, "k", "ts", "v", bucket).collect()} == wanted


def test_late_and_repeated_events(spark):
    rows = [(i, at(20 * i), 1, "view", 1.0, "{}") for i in range(12)]
    first = spark.createDataFrame(rows + rows[:3], EVENT)  # repeats come in the same run
    late = spark.createDataFrame([(99, at(1), 1, "view", 1.0, "{}")], EVENT)
    path, runs = scratch(spark, "late"), scratch(spark, "late-runs")
    for part in (first, late):
        part.write.mode("append").parquet(path)
        found = events.closed_hours(events.stream_of(spark, path, first.schema), runs)
    assert {(r.start, r.n) for r in found.collect()} == {(at(0), 6), (at(60), 3), (at(120), 3)}  # the late one is not counted
    once = events.distinct(events.stream_of(spark, path, first.schema).where("event_id < 99"))
    assert sorted(r.event_id for r in once.collect()) == list(range(12))


def test_a_batch_that_runs_again_replaces_its_rows(spark):
    rows = spark.createDataFrame([(i, at(i), 1, "view", 1.0, "{}") for i in range(5)], EVENT)
    path, runs = scratch(spark, "again"), scratch(spark, "again-runs")
    rows.write.parquet(path)
    schema = rows.schema
    for _ in range(2):  # without its checkpoint the second run writes the same batch once more
        found = events.drained(events.stream_of(spark, path, schema).select("event_id"), "append", "again", runs)
        spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{runs}/state"), True)
    assert found.count() == 5


def test_hints_choose_the_join(spark):
    for hint, operator in catalogue.HINTS.items():
        df = catalogue.queries()[f"p19_{hint}_hint"](spark, "/root/testdata/sf0.001")
        assert operator in df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    plan = catalogue.queries()["p20_group_aggregate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_shipdate" in plan and "l_partkey" not in plan


def test_outer_joins_and_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (None, "z")], "k long, a string")
    b = spark.createDataFrame([(2, 5.0), (3, None), (None, 7.0)], "k long, b double")
    counts = {how: a.join(b, "k", how).count() for how in ("inner", "left", "right", "full", "left_semi", "left_anti")}
    assert counts == {"inner": 1, "left": 3, "right": 3, "full": 5, "left_semi": 1, "left_anti": 2}
    assert a.join(b, a["k"].eqNullSafe(b["k"])).count() == 2
    ordered = [r.k for r in a.orderBy(F.col("k").asc_nulls_last()).collect()]
    assert ordered == [1, 2, None]


def test_ties_in_windows(spark):
    a = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, None)], "id long, x int")
    a.createOrReplaceTempView("ties")
    rows = spark.sql("SELECT id, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (ORDER BY x NULLS LAST, id) AS n FROM ties WINDOW w AS (ORDER BY x NULLS LAST)").collect()
    assert sorted(map(tuple, rows)) == [(1, 1, 1, 1), (2, 1, 1, 2), (3, 3, 2, 3), (4, 4, 3, 4)]


@pytest.mark.parametrize("name", ["p90_least_id_of_text", "p94_lines_once", "p98_rates_by_label"])
def test_text_statements_with_nulls(spark, name):
    spark.createDataFrame([(1, None, "en", "s", None), (2, "a\na\nb", "en", "s", 5), (2, "a\na\nb", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long").createOrReplaceTempView("documents")
    spark.createDataFrame([(1, 0, None), (2, 1, 1)], "doc_id long, quality int, toxic int").createOrReplaceTempView("labels")
    rows = spark.sql(catalogue.SQL[name][0]).collect()
    assert len(rows) == {"p90_least_id_of_text": 2, "p94_lines_once": 3, "p98_rates_by_label": 2}[name]
    if name == "p94_lines_once":
        assert sorted(r.text or "" for r in rows) == ["", "a\nb", "a\nb"]
