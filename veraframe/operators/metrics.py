"""Ranking, calibration and abstention metrics over score tables, as aggregates and running sums.

Labels are 0 or 1. Groups are given by ``by``. Running sums are range-partitioned, within groups too, so no metric brings
all rows, or all distinct scores, of a group to one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veraframe.functions.scalars import nll, sigmoid
from veraframe.operators.ordering import percentiles, running


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str]) -> DataFrame:
    return running(df, order, sums, by)


def average_ranks(df: DataFrame, score: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, score, peers, rank): the mean rank of each distinct score, from 1."""
    peers = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("peers"))
    return _running(peers, [F.col(score)], {"upto": F.col("peers")}, by).select(*by, score, "peers", (F.col("upto") - (F.col("peers") - 1) / 2).alias("rank"))


def auroc(df: DataFrame, y: str, score: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, auroc, n_pos, n_neg): mid-rank area under the ROC curve; null with one class only."""
    counts = df.groupBy(*by, score).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) == 0).cast("long")).alias("neg"))
    below = _running(counts, [F.col(score)], {"neg_upto": F.col("neg")}, by)
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    out = below.groupBy(*by).agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auroc"), F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"))
    return out


def average_precision(df: DataFrame, y: str, score: str, key: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, ap): mean precision at each positive, stepping row by row in the order of score (high first) and key."""
    order = [F.col(score).desc(), F.col(key)]
    steps = _running(df, order, {"hits": (F.col(y) == 1).cast("long"), "seen": F.lit(1).cast("long")}, by)
    return steps.groupBy(*by).agg(F.try_divide(F.sum(F.when(F.col(y) == 1, F.col("hits") / F.col("seen"))), F.sum((F.col(y) == 1).cast("long"))).alias("ap"))


def confusion(df: DataFrame, y: str, predicted: Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts and rates of binary predictions; a rate without a base is 0."""
    positive, hit = F.col(y) == 1, predicted
    base = df.groupBy(*by).agg(
        F.count_if(positive & hit).alias("tp"),
        F.count_if(~positive & hit).alias("fp"),
        F.count_if(~positive & ~hit).alias("tn"),
        F.count_if(positive & ~hit).alias("fn"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = base.withColumns({"sensitivity": rate(tp, tp + fn), "specificity": rate(tn, tn + fp), "precision": rate(tp, tp + fp), "accuracy": rate(tp + tn, tp + fp + tn + fn)})
    return out.withColumns({"balanced_accuracy": (F.col("sensitivity") + F.col("specificity")) / 2, "f1": rate(2 * tp, 2 * tp + fp + fn)})


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, rho): Pearson correlation of average ranks; null below three rows, 0 without variance."""
    ranked = df.select(a, b).join(average_ranks(df, a).select(a, F.col("rank").alias("ra")), a).join(average_ranks(df, b).select(b, F.col("rank").alias("rb")), b)
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, F.when((F.stddev_pop("ra") == 0) | (F.stddev_pop("rb") == 0), F.lit(0.0)).otherwise(F.corr("ra", "rb"))).alias("rho"))


def mean_ci(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Mean with a normal 95 % interval."""
    half = 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def calibration_bins(df: DataFrame, y: str, p: Column, bins: int = 15) -> DataFrame:
    """(bin, n, mean_p, mean_y) for bins closed at the right; probability 0 is in the first."""
    edges = reduce(lambda a, b: a + b, [(F.lit(i / bins) < F.col("p")).cast("int") for i in range(1, bins)])
    return df.select(y, p.alias("p")).withColumn("bin", edges).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(y).alias("mean_y"))


def expected_calibration_error(df: DataFrame, y: str, p: Column, bins: int = 15) -> DataFrame:
    gap = F.abs(F.col("mean_p") - F.col("mean_y"))
    return calibration_bins(df, y, p, bins).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def point_losses(df: DataFrame, y: str, p: Column, eps: float = 1e-12, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Mean negative log-likelihood, Brier score and accuracy at 0.5."""
    return df.withColumn("__p", p).groupBy(*by).agg(
        F.avg(nll(F.col(y), F.col("__p"), eps)).alias("nll"),
        F.avg((F.col("__p") - F.col(y)) ** 2).alias("brier"),
        F.avg(((F.col("__p") >= 0.5).cast("int") == F.col(y)).cast("double")).alias("accuracy"),
    )


def fit_temperature(df: DataFrame, y: str, logit: str, low: float = 0.05, high: float = 20.0, points: int = 161, rounds: int = 4) -> float:
    """The temperature with the least mean negative log-likelihood, by grids on its logarithm.

    One pass sums the loss at all points of a grid; the next grid spans the points beside the best one.
    """
    import math

    lo, hi = math.log(low), math.log(high)
    table = df.select(F.col(y).alias("y"), F.col(logit).alias("z"))
    for _ in range(rounds):
        grid = [lo + i * (hi - lo) / (points - 1) for i in range(points)]
        each = table.select("y", "z", F.explode(F.array(*map(F.lit, grid))).alias("t"))
        sums = each.groupBy("t").agg(F.avg(nll(F.col("y"), sigmoid(F.col("z") / F.exp("t")))).alias("loss")).collect()  # a row a point
        losses = {r.t: r.loss for r in sums}
        best = min(range(points), key=lambda i: (losses.get(grid[i], math.inf), i))
        lo, hi = grid[max(0, best - 1)], grid[min(points - 1, best + 1)]
    return math.exp(grid[best])


def conformal_quantile(df: DataFrame, score: str, alpha: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, n, q): the ceil((n + 1)(1 - alpha))-th smallest score, or 1 if there are fewer."""
    counts = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("peers"))
    upto = _running(counts, [F.col(score)], {"upto": F.col("peers")}, by)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    joined = upto.join(sizes, by) if by else upto.crossJoin(F.broadcast(sizes))  # without groups, one row
    rank = F.ceil((F.col("n") + 1) * F.lit(1 - alpha))
    return joined.groupBy(*by, "n").agg(F.coalesce(F.min(F.when(F.col("upto") >= rank, F.col(score))), F.lit(1.0)).alias("q"))


def conformal_fit(df: DataFrame, y: str, p: str, alphas: list[float], mondrian: bool) -> DataFrame:
    """(alpha, q_real, q_fake, n_real, n_fake): thresholds on one minus the probability of the true class."""
    scored = df.select(F.col(y).alias("y"), F.when(F.col(y) == 1, 1 - F.col(p)).otherwise(F.col(p)).alias("s"))
    sizes = scored.agg(F.count_if(F.col("y") == 0).alias("n_real"), F.count_if(F.col("y") == 1).alias("n_fake"))
    out = []
    for a in alphas:
        if mondrian:
            q = conformal_quantile(scored, "s", a, ["y"]).agg(F.max(F.when(F.col("y") == 0, F.col("q"))).alias("q_real"), F.max(F.when(F.col("y") == 1, F.col("q"))).alias("q_fake"))
        else:
            q = conformal_quantile(scored, "s", a).select(F.col("q").alias("q_real"), F.col("q").alias("q_fake"))
        out.append(q.select(F.lit(a).alias("alpha"), "q_real", "q_fake"))
    return reduce(DataFrame.unionByName, out).crossJoin(sizes)


def prediction_sets(df: DataFrame, p: str, q_real: Column, q_fake: Column) -> DataFrame:
    """``df`` with in_real, in_fake and verdict: a class is in the set if its score is within its threshold."""
    out = df.withColumns({"in_real": F.col(p) <= q_real, "in_fake": (1 - F.col(p)) <= q_fake})
    verdict = F.when(F.col("in_real") & ~F.col("in_fake"), "likely_real").when(F.col("in_fake") & ~F.col("in_real"), "likely_manipulated").otherwise("uncertain")
    return out.withColumn("verdict", verdict)


def conformal_evaluation(sets: DataFrame, y: str) -> DataFrame:
    """Coverage (all, real, fake), abstention, empty sets and accuracy of the decided, from prediction sets."""
    covered = F.when(F.col(y) == 1, F.col("in_fake")).otherwise(F.col("in_real")).cast("double")
    decided = F.col("verdict") != "uncertain"
    right = ((F.col("verdict") == "likely_manipulated").cast("int") == F.col(y)).cast("double")
    return sets.agg(
        F.avg(covered).alias("coverage"),
        F.avg(F.when(F.col(y) == 0, covered)).alias("coverage_real"),
        F.avg(F.when(F.col(y) == 1, covered)).alias("coverage_fake"),
        F.avg((~decided).cast("double")).alias("abstention"),
        F.avg((~F.col("in_real") & ~F.col("in_fake")).cast("double")).alias("empty_rate"),
        F.avg(F.when(decided, right)).alias("selective_accuracy"),
    )


def risk_coverage(df: DataFrame, y: str, p: str, key: str, points: int = 21) -> DataFrame:
    """(step, coverage, risk): error rate among the most confident share of rows, for evenly spaced shares.

    Rows are ordered by confidence (high first) and key; a cut is at half-even rounded ``share * n``, one row at least.
    """
    conf = F.greatest(F.col(p), 1 - F.col(p))
    error = ((F.col(p) >= 0.5).cast("int") != F.col(y)).cast("long")
    rows = df.select(conf.alias("conf"), F.col(key).alias("k"), error.alias("error"))
    curve = running(rows, [F.col("conf").desc(), F.col("k")], {"errors": F.col("error"), "seen": F.lit(1).cast("long")})
    n = df.count()
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("step")
    share = 1 / points + F.col("step") * ((1 - 1 / points) / (points - 1))
    cuts = df.sparkSession.range(1).select(step).withColumn("at", F.greatest(F.lit(1), F.bround(share * n)).cast("long"))
    return curve.join(F.broadcast(cuts), F.col("seen") == F.col("at")).select("step", (F.col("seen") / n).alias("coverage"), (F.col("errors") / F.col("seen")).alias("risk"))


def aurc(df: DataFrame, y: str, p: str, key: str) -> DataFrame:
    """Area under the risk-coverage curve: the mean over all prefixes of their error rate."""
    conf = F.greatest(F.col(p), 1 - F.col(p))
    error = ((F.col(p) >= 0.5).cast("int") != F.col(y)).cast("long")
    rows = df.select(conf.alias("conf"), F.col(key).alias("k"), error.alias("error"))
    return running(rows, [F.col("conf").desc(), F.col("k")], {"errors": F.col("error"), "seen": F.lit(1).cast("long")}).agg(F.avg(F.col("errors") / F.col("seen")).alias("aurc"))


def operating_points(df: DataFrame, y: str, z: str, threshold: float = 0.0, tpr: float = 0.9) -> DataFrame:
    """One row: TPR and FPR at a threshold, the threshold that keeps ``tpr`` of the positives, and the FPR there."""
    cut = percentiles(df.filter(F.col(y) == 1), z, {"cut": 1 - tpr}).select("cut")
    return df.crossJoin(F.broadcast(cut)).groupBy("cut").agg(
        F.avg(F.when(F.col(y) == 1, (F.col(z) >= threshold).cast("double"))).alias("tpr"),
        F.avg(F.when(F.col(y) == 0, (F.col(z) >= threshold).cast("double"))).alias("fpr"),
        F.avg(F.when(F.col(y) == 0, (F.col(z) >= F.col("cut")).cast("double"))).alias("fpr_at_tpr"),
    )


def confidence_abstention(df: DataFrame, y: str, p: str, key: str, abstention: float) -> DataFrame:
    """One row: the share that is left out, and the accuracy of the most confident rest."""
    n = df.count()
    keep = max(1, int(round((1 - abstention) * n)))
    conf = F.greatest(F.col(p), 1 - F.col(p))
    right = ((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("long")
    rows = running(df.select(conf.alias("conf"), F.col(key).alias("k"), right.alias("right")), [F.col("conf").desc(), F.col("k")], {"hits": F.col("right"), "seen": F.lit(1).cast("long")})
    return rows.filter(F.col("seen") == keep).select((1 - F.col("seen") / n).alias("abstention"), (F.col("hits") / F.col("seen")).alias("selective_accuracy"))


def statistics_by(df: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """(key, value, n, mean, low, high): a value's statistics over all rows (key ``all``) and by each of ``keys``."""
    every = [F.struct(F.lit("all").alias("key"), F.lit("").alias("value"))]
    every += [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in keys]
    rows = df.select(F.col(value).alias("v"), F.explode(F.array(*every)).alias("k"))
    return rows.groupBy("k.key", "k.value").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))


def agreement_summary(df: DataFrame, value: str, at_least: float) -> DataFrame:
    """One row on the rank agreements of items: n, pass_rate (the share of ``at_least`` or more), p10 and median, over those
    that are not null; without any, n is 0 and the rest null."""
    known = df.filter(F.col(value).isNotNull())
    rate = known.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(value) >= at_least).cast("double")).alias("pass_rate"))
    middle = percentiles(known, value, {"p10": 0.1, "median": 0.5}).drop("n")
    return rate.join(middle, how="left")  # one row each
