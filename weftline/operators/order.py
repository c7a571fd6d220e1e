"""Work along one global order without a window over all rows: range partitions, their totals, and prefix sums of these."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.tables import kept

def clashing(df: DataFrame, names) -> None:
    """Raise if `df` has one of the columns that an operator adds."""
    taken = sorted({c.lower() for c in df.columns} & {n.lower() for n in names})
    if taken:
        raise ValueError(f"columns {taken} are there already; choose other names")


def before(df: DataFrame, order: list[Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """`df` with, for each of `sums`, the sum over all rows that stand before a row in `order`; 0 for the first.

    Rows that `order` leaves equal stand in any order, but all in one range partition: aggregate by the order's keys first
    where one of them may hold very many rows. Spark samples the bounds of the ranges; the table is written once, so that bounds
    and totals belong to the same rows. Nulls of a summed column count as 0. There are `parts` ranges, or as many as spark.sql.shuffle.partitions
    at most; the driver gets a row of totals for each. An empty table stays empty.
    """
    clashing(df, [*sums, "_part", *(f"_at_{k}" for k in sums)])
    ranged = kept((df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)).withColumn("_part", F.spark_partition_id()), "ranged")
    zero = {k: F.coalesce(v, F.lit(0)) for k, v in sums.items()}
    totals = ranged.groupBy("_part").agg(*(F.sum(v).alias(f"_at_{k}") for k, v in zero.items()))
    rows = sorted(totals.collect())
    starts = [[0, *accumulate(r[i + 1] for r in rows)][: len(rows)] for i in range(len(sums))]
    offsets = df.sparkSession.createDataFrame([(r[0], *(s[j] for s in starts)) for j, r in enumerate(rows)], totals.schema)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), "_part")
    return out.withColumns({k: F.col(f"_at_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in zero.items()}).drop("_part", *(f"_at_{k}" for k in sums))
