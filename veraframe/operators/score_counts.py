"""Grouped metrics from mergeable partial results: how many positives and negatives each distinct score of a group has.

Counts are summed map-side before they are shuffled, and counts of several tables (days, shards, runs) merge by summing, so a
metric is brought up to date without the old rows. Metrics run over the counts by sums over a total order: no group is in one
task or one Python call. Defined cases: rows without a score or with a label other than 0 and 1 are not counted; null groups are
groups; a group without positives has no average precision, one with one class no AUROC; no rows give no groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veraframe.operators.ordering import running


def score_counts(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """(by, score, pos, neg) of each distinct score."""
    known = df.filter(F.col(score).isNotNull() & F.col(y).isin(0, 1))
    return known.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def merged(*counts: DataFrame) -> DataFrame:
    """The counts of all rows that the given counts were taken of."""
    both = reduce(DataFrame.unionByName, counts)
    return both.groupBy(*[c for c in both.columns if c not in ("pos", "neg")]).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def auroc_of(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, auroc): ties count half."""
    upto = running(counts, [F.col("score")], {"below": F.col("neg")}, by)
    return upto.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auroc"))


def average_precision_of(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, ap): precision at each distinct score, high first, weighted by its share of the positives; equal scores are one step."""
    steps = running(counts, [F.col("score").desc()], {"hits": F.col("pos"), "seen": F.col("pos") + F.col("neg")}, by)
    return steps.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * F.col("hits") / F.col("seen")), F.sum("pos")).alias("ap"))


def calibration_error_of(counts: DataFrame, by: list[str], p: Column, bins: int = 15) -> DataFrame:
    """(by, ece) for the probability ``p`` of ``score``; bins are closed at the right and there are ``bins`` rows a group at most."""
    n = F.col("pos") + F.col("neg")
    edges = reduce(lambda a, b: a + b, [(F.lit(i / bins) < F.col("p")).cast("int") for i in range(1, bins)])
    each = counts.withColumn("p", p).withColumn("bin", edges).groupBy(*by, "bin").agg(F.sum(n).alias("n"), F.sum(F.col("p") * n).alias("sum_p"), F.sum("pos").alias("pos"))
    return each.groupBy(*by).agg((F.sum(F.abs(F.col("sum_p") - F.col("pos"))) / F.sum("n")).alias("ece"))


def conformal_quantile_of(counts: DataFrame, by: list[str], alpha: float) -> DataFrame:
    """(by, n, q): the ceil((n + 1)(1 - alpha))-th smallest score of all rows, or 1 if there are fewer."""
    n = F.col("pos") + F.col("neg")
    sizes = counts.groupBy(*[F.col(c).alias(f"__of_{c}") for c in by]).agg(F.sum(n).alias("n"))
    here = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by], F.lit(True))
    ranked = running(counts, [F.col("score")], {"upto": n}, by).join(sizes, here)
    found = F.min(F.when(F.col("upto") >= F.ceil((F.col("n") + 1) * F.lit(1 - alpha)), F.col("score")))
    return ranked.groupBy(*by, "n").agg(F.coalesce(found, F.lit(1.0)).alias("q"))
