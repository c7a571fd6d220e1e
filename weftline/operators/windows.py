"""Window functions over partitions of any size: an ordered partition is cut at sampled bounds, and what a cut hides is carried over.

Rows are range-partitioned by key and order, so one key may fill many ranges and equal order values are always in one. Windows
run within each range. A range that goes on with the key of the one before takes over that key's rows, distinct order values, sums
and last few values so far, and the first few of the next range for values that lie ahead; all these are one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from weftline.operators.joins import named, row_of
from weftline.operators.order import clashing
from weftline.sources.tables import kept

RANKS = ("row_number", "rank", "dense_rank")


def alike(a, b) -> bool:
    return a == b or (a != a and b != b)


def directed(i: int, up: bool) -> Column:
    """An order column; nulls come first going up and last going down."""
    return F.col(f"o{i}").asc_nulls_first() if up else F.col(f"o{i}").desc_nulls_last()


def carried(rows: list, sums: int, shifts: int, most: int) -> list[list]:
    """For each range, in order: key, rows, distinct order values, sums and last values of its first key so far; then the first values behind it of its last key."""
    out, now = [], None
    for r in rows:
        own = [r["last"], r["n"], r["d"], *(r[f"s{i}"] for i in range(sums)), *(list(r[f"tail{i}"] or []) for i in range(shifts))]
        out.append(now if now is not None and alike(now[0], r["first"]) else None)
        if out[-1] is not None and alike(r["first"], r["last"]):
            add = lambda a, b: b if a is None else a if b is None else a + b
            own = [own[0], *(add(a, b) for a, b in zip(now[1 : 3 + sums], own[1 : 3 + sums], strict=True)), *((a + b)[-most:] for a, b in zip(now[3 + sums :], own[3 + sums :], strict=True))]
        now = own
    ahead, now = [], None
    for r in reversed(rows):
        own = [r["first"], *(list(r[f"head{i}"] or []) for i in range(shifts))]
        ahead.append(now if now is not None and alike(now[0], r["last"]) else None)
        if ahead[-1] is not None and alike(r["first"], r["last"]):
            own = [own[0], *((a + b)[:most] for a, b in zip(own[1:], now[1:], strict=True))]
        now = own
    blank, none = [None] * (3 + sums + shifts), [None] * (1 + shifts)
    return [[r["part"], a is not None, *(a or blank)[1:], b is not None, *(b or none)[1:]] for r, a, b in zip(rows, out, reversed(ahead), strict=True)]


def over_ranges(df: DataFrame, by: str, order: list[str | tuple[str, bool]], ranks=RANKS, sums: dict[str, str] | None = None, shifts: dict[str, tuple[str, int]] | None = None, parts: int | None = None) -> DataFrame:
    """`df` with the columns `ranks` (of RANKS), running `sums` {name: column} and `shifts` {name: (column, k)} over (PARTITION BY `by` ORDER BY `order`).

    Sums run up to and with the rows of equal order, as SQL's default frame does. A shift by k > 0 is lag, by k < 0 lead, null where there is no such row; it
    and row_number are the same on every run only if the order has no ties or they do not show. `order` names columns, or (column, whether it
    goes up); nulls come first going up and last going down. Null keys are one partition. The driver gets a row for each of `parts` ranges (spark.sql.shuffle.partitions if not given). An
    empty table stays empty. Columns that are there already may not be named again.
    """
    sums, shifts = sums or {}, shifts or {}
    clashing(df, [*ranks, *sums, *shifts])
    sources = {f"s{i}": named(c) for i, c in enumerate(sums.values())} | {f"v{i}": named(c) for i, (c, _) in enumerate(shifts.values())}
    most = max([abs(k) for _, k in shifts.values()], default=0)
    order = [o if isinstance(o, tuple) else (o, True) for o in order]
    rows = df.select(row_of(df).alias("row"), named(by).alias("k"), *(named(c).alias(f"o{i}") for i, (c, _) in enumerate(order)), *(c.alias(n) for n, c in sources.items()))
    line = [directed(i, up) for i, (_, up) in enumerate(order)]
    spread = [F.col("k").asc_nulls_first(), *line]
    ranged = kept((rows.repartitionByRange(parts, *spread) if parts else rows.repartitionByRange(*spread)).withColumn("part", F.spark_partition_id()), "ranged")
    ends = ranged.groupBy("part").agg(F.min(F.struct("k")).alias("first"), F.max(F.struct("k")).alias("last"))
    last = ranged.join(F.broadcast(ends), "part").where(F.col("k").eqNullSafe(F.col("last.k")))
    tie = F.struct(*(f"o{i}" for i in range(len(order))))
    whole = last.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct(F.struct(tie)).alias("d"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(sums))))
    summary = ends.join(whole, "part")
    if shifts:
        for side, end, turn in (("tail", "last", True), ("head", "first", False)):
            own = ranged.join(F.broadcast(ends), "part").where(F.col("k").eqNullSafe(F.col(f"{end}.k")))
            place = F.row_number().over(Window.partitionBy("part").orderBy(*(directed(i, up != turn) for i, (_, up) in enumerate(order))))
            few = own.withColumn("place", place).where(F.col("place") <= most)
            values = {f"{side}{i}": F.transform(F.array_sort(F.collect_list(F.struct((-F.col("place") if turn else F.col("place")).alias("at"), F.col(f"v{i}").alias("x")))), lambda s: s["x"]) for i in range(len(shifts))}
            summary = summary.join(few.groupBy("part").agg(*(c.alias(n) for n, c in values.items())), "part")
    found = sorted(summary.select("*", F.col("first.k").alias("_f"), F.col("last.k").alias("_l")).drop("first", "last").withColumnsRenamed({"_f": "first", "_l": "last"}).collect(), key=lambda r: r["part"])
    kinds = {f.name: f.dataType for f in summary.schema.fields}
    fields = [("part", kinds["part"]), ("goes_on", BooleanType()), ("cn", LongType()), ("cd", LongType()), *((f"cs{i}", kinds[f"s{i}"]) for i in range(len(sums))), *((f"tail{i}", kinds[f"tail{i}"]) for i in range(len(shifts))), ("comes", BooleanType()), *((f"head{i}", kinds[f"head{i}"]) for i in range(len(shifts)))]
    schema = StructType([StructField(n, t) for n, t in fields])
    carry = df.sparkSession.createDataFrame(carried(found, len(sums), len(shifts), most), schema)
    w = Window.partitionBy("part", "k").orderBy(*line)
    inside = {"n": F.row_number().over(w), "size": F.count("*").over(Window.partitionBy("part", "k")), "r": F.rank().over(w), "dense": F.dense_rank().over(w)}
    inside |= {f"t{i}": F.sum(f"s{i}").over(w) for i in range(len(sums))} | {f"u{i}": (F.lag if k > 0 else F.lead)(f"v{i}", abs(k)).over(w) for i, (_, k) in enumerate(shifts.values())}
    out = ranged.withColumns(inside).join(F.broadcast(carry), "part").join(F.broadcast(ends), "part")
    on = F.col("goes_on") & F.col("k").eqNullSafe(F.col("first.k"))
    plus = lambda a, b: F.when(on, F.coalesce(F.col(a) + F.col(b), F.col(a), F.col(b))).otherwise(F.col(a))
    made = {"row_number": plus("n", "cn"), "rank": plus("r", "cn"), "dense_rank": plus("dense", "cd")}
    columns = {name: made[name].cast("long") for name in ranks} | {name: plus(f"t{i}", f"cs{i}") for i, name in enumerate(sums)}
    for i, (name, (_, k)) in enumerate(shifts.items()):
        if k > 0:
            far = F.when(on & (F.size(f"tail{i}") + F.col("n") > k), F.get(f"tail{i}", F.size(f"tail{i}") + F.col("n") - k - 1))
            columns[name] = F.when(F.col("n") > k, F.col(f"u{i}")).otherwise(far)
        else:
            rest = F.col("size") - F.col("n")
            far = F.when(F.col("comes") & F.col("k").eqNullSafe(F.col("last.k")), F.get(f"head{i}", (-k - rest - 1).cast("int")))
            columns[name] = F.when(rest >= -k, F.col(f"u{i}")).otherwise(far)
    return out.select(*(F.col("row").getField(c).alias(c) for c in df.columns), *(c.alias(n) for n, c in columns.items()))
