"""Joins that Spark has no keyword for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.order import clashing
from weftline.sources.tables import kept


def named(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def row_of(df: DataFrame) -> Column:
    return F.struct(*(named(c) for c in df.columns))


def as_of(probes: DataFrame, facts: DataFrame, by: str, time: str, value: str, bucket: str = "day", name: str | None = None) -> DataFrame:
    """For each probe the `value` of the last fact of its key at or before its time, as column `name` (null: none).

    `name` is that of the value if not given; a probe column of that name is an error, any other column stays as it is.
    Both sides are united and cut into buckets of time, so that a key with very many rows is many groups. A window over a
    key's bucket finds the last fact within it; what earlier buckets leave behind is one row a bucket, carried on by a
    window over these. Of facts with equal times the one with the largest value counts; facts without a key, a time or
    a value count nothing, and probes without a key or a time find none.
    """
    name = name or value
    clashing(probes, [name])
    side = lambda df, row, v, probe: df.select(named(by).alias("key"), named(time).alias("time"), v.alias("v"), row.alias("row"), F.lit(probe).alias("probe"))
    sound = facts.where(named(by).isNotNull() & named(time).isNotNull() & named(value).isNotNull())
    whole = row_of(probes)
    no_row, no_value = F.lit(None).cast(probes.select(whole.alias("row")).schema["row"].dataType), F.lit(None).cast(facts.schema[value].dataType)
    both = side(probes, whole, no_value, 1).unionByName(side(sound, no_row, named(value), 0)).withColumn("at", F.date_trunc(bucket, "time"))
    within = Window.partitionBy("key", "at").orderBy("time", "probe", "v").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("near", F.last("v", ignorenulls=True).over(within)).where("probe = 1").select("key", "at", "row", "near")
    last = F.max(F.when(F.col("probe") == 0, F.struct("time", "v")))["v"]
    earlier = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(F.col("key").alias("k"), F.col("at").alias("b")).agg(last.alias("last")).withColumn("far", F.last("last", ignorenulls=True).over(earlier))
    out = found.join(carried, (F.col("key") == F.col("k")) & (F.col("at") == F.col("b")), "left")
    return out.select(*(F.col("row").getField(c).alias(c) for c in probes.columns), F.coalesce("near", "far").alias(name))


def micros(df: DataFrame, time: str) -> Column:
    """Microseconds since 1970; wall-clock times are counted as they are, whatever the session's zone."""
    if df.schema[time].dataType.typeName() == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), named(time))
    return F.unix_micros(named(time).cast("timestamp"))


def soon_after(first: DataFrame, then: DataFrame, by: str, time: str, span: float, names: tuple[str, str] = ("first", "then"), then_by: str | None = None, then_time: str | None = None) -> DataFrame:
    """All pairs of rows with one key of which the second is after the first by at most `span` seconds, as two structs.

    Time is cut into buckets as long as the span, a second part of the key: what follows a row within the span is in its
    bucket or the next, so a first row stands in two buckets and a second one in its own. A key with very many rows is as many
    groups as it has buckets. The span itself is tested on the pair. Rows without a key or a time are in no pair.
    """
    if span <= 0:
        raise ValueError("span has to be positive")
    length, then_by, then_time = round(span * 1_000_000), then_by or by, then_time or time
    a = first.select(named(by).alias("k1"), micros(first, time).alias("t1"), row_of(first).alias("a")).where("k1 IS NOT NULL AND t1 IS NOT NULL")
    b = then.select(named(then_by).alias("k2"), micros(then, then_time).alias("t2"), row_of(then).alias("b")).where("k2 IS NOT NULL AND t2 IS NOT NULL")
    number = lambda t: F.expr(f"({t} - pmod({t}, {length})) DIV {length}")
    a = a.select("k1", "t1", "a", F.explode(F.array(number("t1"), number("t1") + 1)).alias("b1"))
    b = b.withColumn("b2", number("t2"))
    pairs = a.join(b, (F.col("k1") == F.col("k2")) & (F.col("b1") == F.col("b2")) & (F.col("t2") > F.col("t1")) & (F.col("t2") <= F.col("t1") + length))
    return pairs.select(F.col("a").alias(names[0]), F.col("b").alias(names[1]))


#: Rows of the smaller side of a theta join that are broadcast. Beyond that: its rows in a block, and the cells that the pairs of the other side and a block are cut into.
MOST_BROADCAST, BLOCK, CELLS = 10_000, 1024, 16


def fits(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def theta(many: DataFrame, few: DataFrame, condition: Column, key: tuple[str, str], most: int = MOST_BROADCAST, by: str | None = None) -> DataFrame:
    """All pairs of a row of `many` and one of `few` with equal keys for which `condition` holds, with the columns of both.

    The work is in the pairs, so `many` is dealt evenly, however it is stored and however few keys there are, to as many tasks as
    spark.sql.shuffle.partitions, which adaptive execution does not join by their bytes. `few` is broadcast up to `most` rows, which is
    checked. Beyond that its rows are in blocks of BLOCK rows at most that are next to each other by key and `by`, the column of `few`
    that the condition compares: a row of `many` stands in one of CELLS cells of each block of its key, a row of `few` in all cells of
    its block. Pairs stream out of the join, no task holds them, and a row of `many` meets one block at a time.

    Blocks are there for what is made of the pairs too: row upon row of `many` comes with the same rows of `few`, mostly all of a block
    or none, which files of columns hold in a small part of the room of all matches of a row at once. Columns of the two sides need
    different names.
    """
    own = ["_key", "_block", "_block_", "_cell", "_cell_"]
    clashing(many, [*few.columns, *own])
    clashing(few, own)
    parts, same = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")), named(key[0]) == named(key[1])
    if fits(few, most):
        return many.repartition(parts).join(F.broadcast(few), same & condition)
    order = [*(named(c) for c in (key[1], by) if c), F.xxhash64(*(named(c) for c in few.columns))]  # the last parts what the others leave equal
    ranged = few.where(named(key[1]).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    blocked = kept(ranged.withColumn("_block", F.expr(f"monotonically_increasing_id() DIV {BLOCK}")), "blocks")  # both sides see the same blocks
    blocks = blocked.select(named(key[1]).alias("_key"), "_block").distinct()
    blocks = F.broadcast(blocks) if fits(blocks, most) else blocks
    cell = F.pmod(F.xxhash64(*(named(c) for c in many.columns)), F.lit(CELLS)).cast("int")
    dealt = many.repartition(parts).withColumn("_cell", cell).join(blocks, named(key[0]) == F.col("_key")).drop("_key")
    cells = blocked.withColumnRenamed("_block", "_block_").withColumn("_cell_", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))))
    on = same & (F.col("_block") == F.col("_block_")) & (F.col("_cell") == F.col("_cell_")) & condition
    pairs = dealt.repartition(parts, named(key[0]), "_block", "_cell").join(cells.repartition(parts, named(key[1]), "_block_", "_cell_").hint("merge"), on)
    return pairs.drop("_block", "_cell", "_block_", "_cell_")
