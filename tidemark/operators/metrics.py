"""Exact ranking metrics from counts of positives and negatives by distinct score.

Running sums over all distinct scores would pass through one task. So scores are ranged first, by approximate quantiles
that stand as numbers in the plan (so that all its branches and any repeated task see the same ranges); every range adds up
its own counts, and only the ranges' totals are summed in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of scores, about, each of which is one task's.
RANGES = 64


def by_score(df: DataFrame) -> DataFrame:
    """score, pos, neg, and the counts of scores above it (tp_above, fp_above)."""
    known = df.where(F.col("score").isNotNull() & F.col("label").isNotNull())
    counts = known.groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum(1 - F.col("label").cast("long")).alias("neg"))
    bounds = sorted(set(known.approxQuantile("score", [k / RANGES for k in range(1, RANGES)], 0.25 / RANGES)))
    # One small expression, as it stands in every filter, window and join that follows.
    above = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b > F.col("score"))) if bounds else F.lit(0)
    ranged = counts.withColumn("_part", above)
    inside = Window.partitionBy("_part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy(F.col("_top").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(F.max("score").alias("_top"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    totals = totals.select("_part", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    own = ranged.select("*", F.coalesce(F.sum("pos").over(inside), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg").over(inside), F.lit(0)).alias("fp"))
    return own.join(totals, "_part").select("score", "pos", "neg", (F.col("tp") + F.col("_p")).alias("tp_above"), (F.col("fp") + F.col("_n")).alias("fp_above"))


def auroc(df: DataFrame) -> DataFrame:
    """One row with the area under the ROC curve; ties count half. Null if a class is missing."""
    p, n = F.sum("pos"), F.sum("neg")
    wins = F.sum(F.col("neg") * (F.col("tp_above") + F.col("pos") * F.lit(0.5)))
    return by_score(df).agg(F.when((p > 0) & (n > 0), wins / (p * n.cast("double"))).alias("auroc"))


def average_precision(df: DataFrame) -> DataFrame:
    """One row with the sum over scores of precision times the gain in recall."""
    tp = F.col("tp_above") + F.col("pos")
    precision = tp / (tp + F.col("fp_above") + F.col("neg"))
    return by_score(df).agg((F.sum(precision * F.col("pos")) / F.sum("pos")).alias("average_precision"))
