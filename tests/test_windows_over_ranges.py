"""Windows over cut partitions against Spark's own windows over whole ones."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators.windows import over_ranges

SUMS, SHIFTS = {"s": "x", "s2": "k"}, {"lag1": ("o", 1), "lag40": ("o", 40), "lead2": ("o", -2), "lead300": ("o", -300)}


def plainly(df, up):
    order = F.col("o").asc_nulls_first() if up else F.col("o").desc_nulls_last()
    w = Window.partitionBy("by").orderBy(order)
    out = df.withColumns({"rank": F.rank().over(w).cast("long"), "dense_rank": F.dense_rank().over(w).cast("long"), **{n: F.sum(c).over(w) for n, c in SUMS.items()}})
    return out.withColumns({n: (F.lag if k > 0 else F.lead)(c, abs(k)).over(w) for n, (c, k) in SHIFTS.items()})


def rows_of(draw, kind):
    if kind == "one key":
        return [(1, int(o), int(x), int(x) % 5) for o, x in zip(draw.integers(0, 4000, 3000), draw.integers(0, 9, 3000))]
    if kind == "ties":  # a tie may be larger than a range would be
        return [(1 if i % 10 else i % 3, int(draw.integers(0, 6)), i % 7, 1) for i in range(2500)]
    by = [None, 1, 2, 3, 4]
    return [(by[int(draw.integers(0, 5)) if i % 3 else 1], None if i % 11 == 0 else int(draw.integers(0, 500)), None if i % 5 == 0 else i % 9, 2) for i in range(2000)]


@pytest.mark.parametrize(("kind", "parts", "up"), [("one key", 40, True), ("one key", 7, False), ("ties", 5, True), ("odd", 3, False), ("odd", 60, True), ("odd", 60, False)])
def test_like_whole_windows(spark, kind, parts, up):
    rows = rows_of(np.random.default_rng(21), kind)
    df = spark.createDataFrame(rows, "by long, o long, x long, k long").repartition(6)
    found = over_ranges(df, "by", [("o", up)], ("rank", "dense_rank"), SUMS, SHIFTS, parts=parts)
    wanted = plainly(df, up)
    assert found.columns == wanted.columns
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, wanted.collect()), key=key)


def test_row_numbers_names_and_nothing(spark):
    df = spark.range(1000).select(F.expr("id % 2").alias("k"), F.expr("(id * 37) % 1000").alias("part"), F.lit("x").alias("row"))
    found = over_ranges(df, "k", ["part"], parts=9)
    w = Window.partitionBy("k").orderBy("part")
    assert found.columns == ["k", "part", "row", "row_number", "rank", "dense_rank"]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, df.withColumns({n: f().over(w) for n, f in (("row_number", F.row_number), ("rank", F.rank), ("dense_rank", F.dense_rank))}).collect()))
    assert over_ranges(df.limit(0), "k", ["part"], sums={"s": "part"}, shifts={"l": ("part", 1)}).count() == 0
    with pytest.raises(ValueError):
        over_ranges(df.withColumnRenamed("row", "rank"), "k", ["part"])


def test_a_huge_partition_is_many_tasks(spark):
    df = spark.range(20000).select(F.lit(1).alias("by"), F.col("id").alias("o"))
    found = over_ranges(df, "by", ["o"], ("row_number",), parts=20)
    assert "hashpartitioning(part#" in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("row_number <> o + 1").isEmpty()
