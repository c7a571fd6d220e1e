"""Evaluation of a score against labels: curves, areas under them and calibration, without a window over all rows.

Rows are first counted by score, so equal scores are one point and a score that very many rows share is one row. Points are then
ranked along range partitions (`order.before`), of which only the totals meet on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.order import before
from weftline.sources.tables import kept


def points(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg): labelled rows by score. Rows whose score is null or NaN, or whose label is neither 0 nor 1, take no part; -0.0 is 0.0.

    The counts are written once, as bounds, ranges and totals all read them, and scores are sifted behind that: a test on a score
    before it would move down to the scan and compute the score a second time.
    """
    s, y = F.col(score).cast("double"), F.col(label).cast("int")
    rows = df.select((s + F.lit(0.0)).alias("score"), y.alias("y")).where("y IN (0, 1)")
    counted = rows.groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    return kept(counted, "points").where("score IS NOT NULL AND NOT isnan(score)")


def totals(found: DataFrame) -> DataFrame:
    """One row: the labelled rows of each kind."""
    return found.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("all_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("all_neg"))


def curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall, fall_out): one point for each distinct score, which counts as predicted from there on.

    A rate whose kind of row is missing is null. An empty table has no points.
    """
    counted = points(df, score, label)
    found = before(counted, [F.col("score").desc()], {"pos_above": F.col("pos"), "neg_above": F.col("neg")})
    sums = totals(counted).first()
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    out = found.select(F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"), (F.lit(sums["all_pos"]) - tp).alias("fn"), (F.lit(sums["all_neg"]) - fp).alias("tn"))
    return out.select("*", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")).alias("fall_out"))


def areas(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row (positives, negatives, auc, average_precision): `auc` from ranks with ties averaged, null where a label is missing.

    Pairs are counted in exact decimals, so the order of rows changes nothing.
    """
    found = before(points(df, score, label), [F.col("score").desc()], {"pos_above": F.col("pos"), "neg_above": F.col("neg")})
    wide = lambda c: c.cast("decimal(19,0)")
    # Pairs that a positive wins: the negatives below it and half of those with its score; twice that, less what stands above.
    lost = wide(F.col("pos")) * wide(2 * F.col("neg_above") + F.col("neg"))
    gain = F.col("pos") * (F.col("pos_above") + F.col("pos")) / (F.col("pos_above") + F.col("pos") + F.col("neg_above") + F.col("neg"))
    sums = found.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"), F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"), F.sum(lost).cast("double").alias("lost"), F.sum(gain.cast("decimal(30,12)")).cast("double").alias("gain"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return sums.select("positives", "negatives", (1 - F.try_divide(F.col("lost"), 2 * pairs)).alias("auc"), F.try_divide(F.col("gain"), F.col("positives").cast("double")).alias("average_precision"))


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, rate): scores from 0 to 1 in equal bins (others in the outermost), with the mean score and the share of label 1."""
    bin_ = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("score"))) * bins))).cast("int")
    found = points(df, score, label)
    n = F.col("pos") + F.col("neg")
    return found.groupBy(bin_.alias("bin")).agg(F.sum(n).alias("n"), (F.sum(F.col("score") * n) / F.sum(n)).alias("mean_score"), (F.sum("pos") / F.sum(n)).alias("rate"))
