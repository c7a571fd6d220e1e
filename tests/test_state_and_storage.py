"""Timers, expiring state, table functions and writers: restarts, expiry, pruning and joins without exchange."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from weftline.functions.udfs import Sessions
from weftline.plans import catalogue
from weftline.sources.tables import read_lines, scratch, write_parts
from weftline.streaming import events

START = dt.datetime(2024, 1, 1)
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event(i, hours, user, kind="view"):
    return (i, START + dt.timedelta(hours=hours), user, kind, 1.0, "{}")


def test_timers_fire_once_and_outlive_a_restart(spark):
    own = events.rocks(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    first = [event(1, 0, 1), event(2, 1, 1), event(3, 40, 1), event(4, 0, 2), event(5, 41, 3)]
    runs = [first, [event(6, 42, 1), event(7, 60, 4)], [event(8, 200, 4)], [event(9, 400, 5)]]
    path, at = scratch(spark, "visits"), scratch(spark, "visits-runs")
    seen = []
    for part in runs:
        own.createDataFrame(part, EVENT).write.mode("append").parquet(path)
        out = events.visits(events.stream_of(own, path, own.createDataFrame([], EVENT).schema), at, spark)
        seen.append(sorted((r.user_id, r.first, r.last, r.n) for r in out.collect()))
    h = lambda x: START + dt.timedelta(hours=x)
    assert seen[0] == [(1, h(0), h(1), 2), (2, h(0), h(0), 1)]
    assert seen[1] == sorted(seen[0] + [(1, h(40), h(42), 2), (3, h(41), h(41), 1)])  # 42 + 12 is before 60
    assert seen[2] == sorted(seen[1] + [(4, h(60), h(60), 1)])
    assert seen[3] == sorted(seen[2] + [(4, h(200), h(200), 1)])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_map_state_expires(spark):
    own = events.rocks(spark, idle=False)
    path, at, out = scratch(spark, "kinds"), scratch(spark, "kinds-runs"), None
    for kind in ("view", "click", "view"):
        own.createDataFrame([event(1, 0, 1, kind)], EVENT).write.mode("append").parquet(path)
        out = events.recent_kinds(events.stream_of(own, path, own.createDataFrame([], EVENT).schema), at, expiry_ms=3000, spark=spark)
        time.sleep(4)
    assert sorted((r.kinds, r.n) for r in out.collect()) == [(1, 1)] * 3


def test_map_state_of_buckets_of_users(spark):
    """Users of one bucket, odd ids and events without a user; over a restart."""
    own = events.rocks(spark, idle=False)
    path, at, users = scratch(spark, "kinds"), scratch(spark, "kinds-runs"), [None, 0, -1, 2**53, 2**53 + 1, *range(1, 20)]
    parts = [[event(i, 0, u, kind) for i, u in enumerate(users)] for kind in ("view", "click")] + [[event(1, 0, 5), event(2, 0, None), event(3, 0, 0, None)]]
    seen = set()
    for part in parts:
        own.createDataFrame(part, EVENT).write.mode("append").parquet(path)
        out = events.recent_kinds(events.stream_of(own, path, own.createDataFrame([], EVENT).schema), at, spark=spark, buckets=2)
        found = {tuple(r) for r in out.collect()}
        seen.add(len(found))
    assert found == {(u, k, k) for u in users for k in (1, 2)} | {(5, 2, 3), (None, 2, 3)}
    assert seen == {24, 48, 50}


def test_sessions_of_a_table_argument(spark):
    rows = [(1, START, "x"), (1, START + dt.timedelta(minutes=29), "x"), (1, START + dt.timedelta(minutes=59), "x"), (None, START, "x"), (2, None, "x")]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, start string").repartition(3)
    call = lambda d, key="user_id": Sessions(d.asTable(), F.lit(key), F.lit("ts"), F.lit(30))
    assert sorted(map(tuple, call(df).collect()), key=str) == sorted([(1, START, 2), (1, START + dt.timedelta(minutes=59), 1), (None, START, 1)], key=str)
    assert call(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="no column"):
        call(df, "nobody")
    df.createOrReplaceTempView("session_rows")
    spark.udtf.register("sessions_of", Sessions)
    assert spark.sql("SELECT * FROM sessions_of(TABLE(session_rows), 'user_id', 'ts', 30)").count() == 3


def test_only_named_partitions_change(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(90)], "id long, part string")
    path = scratch(spark, "parts")
    write_parts(df, path, "part")
    for _ in range(2):
        write_parts(df.where("part = 'b' AND id < 30"), path, "part")
    found = spark.read.parquet(path)
    assert {r["part"]: r["n"] for r in found.groupBy("part").agg(F.count("*").alias("n")).collect()} == {"a": 30, "b": 10, "c": 30}
    plan = found.where("part = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_bucketed_join_moves_no_row(spark):
    df = catalogue.queries()["p02_bucketed_join"](spark, "/root/testdata/sf0.001")
    df.collect()
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_corrupt_rows_are_kept(spark):
    path = scratch(spark, "json")
    lines = ['{"a": 1}', '{"a": "x"}', "not json", '{"a": null}', "{}"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    good, bad = read_lines(spark, path, "json", "a long")
    assert sorted((r.a for r in good.collect()), key=str) == [1, None, None] and sorted(r[0] for r in bad.collect()) == ["not json", '{"a": "x"}'][::1]
