"""Streams over the events table; each runs over what is there and returns what it wrote.

Every stream can be replayed: a micro-batch is written to a folder of its own number, so a batch that runs
again after a restart replaces what it wrote before.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weftline.sources.tables import scratch, table

LATE = "10 minutes"


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files with events as a stream, in zoned event time as watermarks need it."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, as the path may be a single file.
    return stream_of(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema)


def drained(df: DataFrame, mode: str, name: str, at: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Run a streaming query until its input ends and read what it wrote, in the session `spark` if it is not the query's own.

    In complete mode each result replaces the last one. With `at` an earlier run is continued from its checkpoint.
    """
    spark, out = spark or df.sparkSession, at or scratch(df.sparkSession, name)
    schema = df.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows" if mode == "complete" else f"{out}/rows/batch={number}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    # Each batch's folder is a root of its own, so that its number is no column.
    return spark.read.schema(schema).parquet(f"{out}/rows" if mode == "complete" else f"{out}/rows/*")


def hourly(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))


def by_start(counts: DataFrame, window: str, *keys: str) -> DataFrame:
    return counts.select(*keys, F.col(f"{window}.start").cast("timestamp_ntz").alias("start"), "n")


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hours so far, in complete mode: the result is the state, which grows with the hours."""
    return by_start(drained(hourly(stream(spark, sf_dir)), "complete", "tumbling"), "window")


def closed_hours(events: DataFrame, at: str | None = None) -> DataFrame:
    """Hours that the watermark has passed, in append mode; later rows of theirs are dropped, and so is their state."""
    return by_start(drained(hourly(events.withWatermark("ts", LATE)), "append", "hours", at), "window")


def distinct(events: DataFrame) -> DataFrame:
    """Each event once, as long as its repeats come within the watermark."""
    once = events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])
    return drained(once, "append", "distinct").select("event_id", "user_id")


def distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readers send every event twice; it comes out once."""
    return distinct(stream(spark, sf_dir).unionByName(stream(spark, sf_dir)))


def purchases_after_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a view and a purchase of one user within the hour behind it, joined as two streams."""
    both = stream(spark, sf_dir).withWatermark("ts", LATE)
    a = both.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("u"), F.col("ts").alias("t"))
    b = both.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("t2"))
    joined = a.join(b, F.expr("u = user_id AND t2 > t AND t2 <= t + INTERVAL 1 HOUR"))
    return drained(joined.select("view_id", "purchase_id", "user_id"), "append", "pairs")


def by_session(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user with gaps under 30 minutes are one session; all sessions so far, in complete mode."""
    return by_start(drained(by_session(stream(spark, sf_dir)), "complete", "sessions"), "session_window", "user_id")


def closed_sessions(events: DataFrame) -> DataFrame:
    """Sessions that the watermark has passed, in append mode."""
    return by_start(drained(by_session(events.withWatermark("ts", LATE)), "append", "sessions"), "session_window", "user_id")


def with_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream joined with a table; no state is kept."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return drained(stream(spark, sf_dir).select("event_id", "user_id").join(customers, "user_id"), "append", "segments").select("event_id", "c_mktsegment")


def in_runs(parts: list[DataFrame], schema, run=None) -> DataFrame:
    """What `run` (closed hours if not given) makes of a stream that stops after each part of its rows and goes on from its checkpoint with the next."""
    spark = parts[0].sparkSession
    path, at = scratch(spark, "parts"), scratch(spark, "runs")
    for part in parts:
        part.write.mode("append").parquet(path)
        out = (run or closed_hours)(stream_of(spark, path, schema), at)
    return out


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The events, and those of the first and of the second half of January."""
    rows = table(spark, sf_dir, "events")
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    return rows, rows.where(F.col("ts") < middle), rows.where(F.col("ts") >= middle)


def restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, first, second = halves(spark, sf_dir)
    return in_runs([first, second], rows.schema)


def late_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half comes once more behind the second one: too late for the watermark, so nothing of it counts."""
    rows, first, second = halves(spark, sf_dir)
    return in_runs([first, second, first], rows.schema)


class Totals(StatefulProcessor):
    """How many events of a user there were so far, and the highest value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n long, top double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, top = self.total.get() if self.total.exists() else (0, float("-inf"))
        for chunk in rows:
            n, top = n + len(chunk), max(top, float(chunk["value"].max()))
        self.total.update((n, top))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "top": [top]})

    def close(self) -> None:
        pass


def rocks(spark: SparkSession, idle: bool = True) -> SparkSession:
    """A session beside the caller's that keeps state in RocksDB, so that no setting of the caller's changes.

    `idle` batches, without rows, run timers of event time; state that expires in processing time would ask for them without end.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", idle)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user so far and the highest value, as state of our own in RocksDB; the last row of a user counts."""
    grouped = stream(rocks(spark), sf_dir).select("user_id", "value").groupBy("user_id")
    totals = grouped.transformWithStateInPandas(Totals(), "user_id long, n long, top double", "update", "none")
    return drained(totals, "update", "totals", spark=spark).groupBy("user_id").agg(F.max("n").alias("n"), F.max("top").alias("top"))


#: Microseconds.
QUIET = 12 * 3_600_000_000


class Visits(StatefulProcessor):
    """Visits of a user: events with less than QUIET between them. A timer on event time closes a visit once no event can follow.

    The state is the open visit as (first, last, n), however many events it has; a later visit in the same batch closes the one before at once.
    Each call to the state is a round trip to the JVM, so a user costs three or four of them a batch and one frame of rows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, n long")  # microseconds

    def closed(self, key, first, last, n) -> pd.DataFrame:
        return pd.DataFrame({"user_id": key[0], "first": np.array(first, "datetime64[us]"), "last": np.array(last, "datetime64[us]"), "n": n})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([chunk["ts"].to_numpy("datetime64[us]").astype(np.int64) for chunk in rows]))
        cuts = np.flatnonzero(np.diff(times) >= QUIET) + 1
        begins, ends = np.append(0, cuts), np.append(cuts, len(times))
        first, last, n = times[begins], times[ends - 1], ends - begins
        if known := self.open.get():
            # Visits that touch the open one stand side by side and are one with it; a and b are their bounds.
            a, b = np.searchsorted(last, known[0] - QUIET, "right"), np.searchsorted(first, known[1] + QUIET, "left")
            one = (min([known[0], *first[a:b].tolist()]), max([known[1], *last[a:b].tolist()]), known[2] + int(n[a:b].sum()))
            first, last, n = (np.concatenate([v[:a], [x], v[b:]]) for v, x in zip((first, last, n), one, strict=True))
            self.handle.deleteTimer((known[1] + QUIET) // 1000)
        if len(first) > 1:
            yield self.closed(key, first[:-1], last[:-1], n[:-1])
        self.open.update((int(first[-1]), int(last[-1]), int(n[-1])))
        self.handle.registerTimer((int(last[-1]) + QUIET) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.open.get()
        self.open.clear()
        if known:
            yield self.closed(key, *([x] for x in known))

    def close(self) -> None:
        pass


def visits(events: DataFrame, at: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """(user_id, first, last, n) of every visit that is over, each once; open ones stay in the state, with their timers, for the next run."""
    grouped = events.withWatermark("ts", LATE).select("user_id", "ts").groupBy("user_id")
    out = grouped.transformWithStateInPandas(Visits(), "user_id long, first timestamp, last timestamp, n long", "append", "eventtime")
    found = drained(out, "append", "visits", at, spark)
    return found.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


def closed_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits over a restart: the second run goes on with the state and timers of the first."""
    rows, first, second = halves(rocks(spark), sf_dir)
    return in_runs([first, second], rows.schema, lambda events, at: visits(events, at, spark))


#: So many events, about, are those of one bucket of users.
EVENTS_OF_A_BUCKET = 5000


class Kinds(StatefulProcessor):
    """The kinds of events of the users of a bucket, in a map whose entries expire some time after they were last seen.

    Events without a user are a bucket of their own, null. Rows without a column `user_id` are those of one user, the key.
    """

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kinds = handle.getMapState("kinds", "user_id long, kind string", "n long", self.expiry_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # The map is read once and each kind of a user written once: every call to the state is a round trip to the JVM.
        fresh: Counter = Counter()
        for chunk in rows:
            users = chunk["user_id"].tolist() if "user_id" in chunk else [key[0]] * len(chunk)
            fresh.update(zip(users, chunk["event_type"].tolist(), strict=True))
        held = {tuple(k): v[0] for k, v in self.kinds.iterator()}
        for entry, n in fresh.items():
            held[entry] = held.get(entry, 0) + n
            self.kinds.updateValue(entry, (held[entry],))
        seen = dict.fromkeys(user for user, _ in fresh)
        kinds, total = Counter(), Counter()
        for (user, _), n in held.items():
            kinds[user] += 1
            total[user] += n
        yield pd.DataFrame({"user_id": [None if pd.isna(key[0]) else u for u in seen], "kinds": [kinds[u] for u in seen], "n": [total[u] for u in seen]})

    def close(self) -> None:
        pass


def recent_kinds(events: DataFrame, at: str | None = None, expiry_ms: int = 86_400_000, spark: SparkSession | None = None, buckets: int = 64) -> DataFrame:
    """(user_id, kinds, n) after each batch: the kinds of events of a user seen within the expiry (processing time), and these events.

    A key of the state is a bucket of users, as every key costs some milliseconds a batch whatever it holds. A stream keeps its
    number of buckets over restarts. The events' session must not run idle batches (`rocks(spark, idle=False)`).
    """
    user = F.col("user_id").cast("long")
    bucket = F.when(user.isNotNull(), F.pmod(F.xxhash64(user), F.lit(buckets))).alias("bucket")
    # A null among the numbers of a frame would make them fractions.
    rows = events.where("event_type IS NOT NULL").select(bucket, F.coalesce(user, F.lit(0)).alias("user_id"), "event_type")
    out = rows.groupBy("bucket").transformWithStateInPandas(Kinds(expiry_ms), "user_id long, kinds long, n long", "update", "processingtime")
    return drained(out, "update", "kinds", at, spark)


def kinds_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and events of each user in all of a restarted stream; the largest counts are the last ones, as nothing expires so soon."""
    rows, first, second = halves(rocks(spark, idle=False), sf_dir)
    buckets = max(64, rows.count() // EVENTS_OF_A_BUCKET)
    found = in_runs([first, second], rows.schema, lambda events, at: recent_kinds(events, at, spark=spark, buckets=buckets))
    return found.groupBy("user_id").agg(F.max("kinds").alias("kinds"), F.max("n").alias("n"))
