"""Exact quantiles by selection: sketches bound where a quantile lies, and only the values between the bounds are ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.order import before, clashing
from weftline.sources.tables import kept

#: How far from the quantile, in rank, the sketch's bounds are set, and its accuracy; bounds that miss are set anew, twice as far.
REACH, ACCURACY = 0.01, 2000


def quantile(df: DataFrame, by: str, value: str, p: float, reach: float = REACH) -> DataFrame:
    """(by, n, quantile): the exact `p` quantile of each group, linear between the two values about it.

    One pass sketches each group and takes values about `reach` below and above the quantile in rank; a second counts what is below
    and keeps what is between. The sketch may err: groups whose quantile is not between its bounds are taken again with twice the reach,
    at last with all their values. Kept values are counted by value, so ties are one row, and ranked along range partitions, so
    no task holds a group. Null and NaN values do not count; groups without others have a null quantile. A null group is a group.
    """
    if not 0 <= p <= 1:
        raise ValueError("p has to be from 0 to 1")
    clashing(df.select(value), ["_g"])
    rows = df.select(F.col(by).alias("_g"), (F.col(value).cast("double") + F.lit(0.0)).alias("v"))
    rows = rows.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    found, left = None, None
    while True:
        part = rows if left is None else rows.join(left, F.col("_g").eqNullSafe(F.col("_again")), "left_semi")
        if reach < 0.5:
            ends = F.percentile_approx("v", [max(0.0, p - reach), min(1.0, p + reach)], ACCURACY)
        else:
            ends = F.array(F.min("v"), F.max("v"))
        bounds = kept(part.groupBy("_g").agg(F.count("v").alias("n"), ends.alias("ends")).select(F.col("_g").alias("_k"), "n", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high")), "bounds")
        inside = part.where("v IS NOT NULL").join(bounds, F.col("_g").eqNullSafe(F.col("_k"))).where("v <= high")
        counts = kept(inside.groupBy("_g", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("c"), F.first("n").alias("n")), "counts")
        # Where the rank asked for falls: floor and ceiling of p (n - 1), counted from 0.
        below = counts.groupBy("_g").agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("below"), F.sum("c").alias("upto"), F.first("n").alias("n"))
        rank = F.lit(p) * (F.col("n") - 1)
        hit = (F.floor(rank) >= F.col("below")) & (F.ceil(rank) < F.col("upto"))
        place = before(counts, [F.col("_g"), F.col("v")], {"ahead": F.col("c")})
        first = place.groupBy("_g").agg(F.min("ahead").alias("_start")).withColumnRenamed("_g", "_k")
        at = place.join(first, F.col("_g").eqNullSafe(F.col("_k"))).where("v IS NOT NULL").withColumn("ahead", F.col("ahead") - F.col("_start"))
        lower = F.max(F.when(F.col("ahead") <= F.floor(rank), F.struct("ahead", "v")))["v"]
        upper = F.max(F.when(F.col("ahead") <= F.ceil(rank), F.struct("ahead", "v")))["v"]
        share = rank - F.floor(rank)
        picked = at.groupBy("_g").agg(F.first("n").alias("n"), lower.alias("a"), upper.alias("b")).select(F.col("_g").alias("_k"), (F.col("a") + share * (F.col("b") - F.col("a"))).alias("quantile"))
        good = below.where(hit).select("_g", "n").join(picked, F.col("_g").eqNullSafe(F.col("_k"))).select("_g", "n", "quantile")
        if found is None:  # groups without values
            good = good.unionByName(bounds.where("n = 0").select(F.col("_k").alias("_g"), "n", F.lit(None).cast("double").alias("quantile")))
        found = good if found is None else found.unionByName(good)
        missed = kept(below.where(~hit).select(F.col("_g").alias("_again")), "missed")
        if missed.isEmpty():
            return found.select(F.col("_g").alias(by), "n", "quantile")
        left, reach = missed, 2 * reach
