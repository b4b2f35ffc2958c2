"""Composed fits: the calibration report, the paired bootstrap, the shortcut probe and similarity transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veraframe.functions.scalars import sigmoid, unit_hash
from veraframe.operators import metrics as M
from veraframe.operators.ordering import running


def calibration_report(scores: DataFrame, levels: list[str], y: str, part: str, alpha: float) -> DataFrame:
    """Per level: temperature from part ``temperature``, thresholds from ``conformal`` and their evaluation on ``train``.

    ``scores`` has a column of scores per level. Only fitted parameters reach the driver.
    """
    out = []
    for level in levels:
        rows = scores.filter(F.col(level).isNotNull())
        t = M.fit_temperature(rows.filter(F.col(part) == "temperature"), y, level)
        rows = rows.withColumn("p", sigmoid(F.col(level) / t))
        fit = M.conformal_fit(rows.filter(F.col(part) == "conformal"), y, "p", [alpha], mondrian=True)
        sets = rows.filter(F.col(part) == "train").crossJoin(F.broadcast(fit.select("q_real", "q_fake")))
        scored = M.conformal_evaluation(M.prediction_sets(sets, "p", F.col("q_real"), F.col("q_fake")), y)
        # A level that has no more calibration rows than 1 / alpha can't support it.
        out.append(fit.crossJoin(scored).select(F.lit(level).alias("level"), F.lit(t).alias("temperature"), "*", (F.lit(alpha) >= 1 / (F.least("n_real", "n_fake") + 1)).alias("supported")))
    return reduce(DataFrame.unionByName, out)


def bootstrap_delta(rows: DataFrame, key: str, y: str, a: str, b: str, replicates: int, seed: int) -> DataFrame:
    """One row: the mean of AUROC(a) - AUROC(b), its 95 % interval and the share of replicates at or below 0.

    Each replicate draws as many rows of each class, with replacement, as there are; draws are seeded hashes. Rows are
    numbered once over the cluster, and a replicate's draws meet them in an equi-join.
    """
    numbered = running(rows.select(y, key, a, b), [F.col(y), F.col(key)], {"nth": F.lit(1).cast("long")})
    sizes = numbered.groupBy(y).agg(F.count(F.lit(1)).alias("size"), F.min("nth").alias("first"))
    table = numbered.join(F.broadcast(sizes), y).withColumn("i", F.col("nth") - F.col("first"))
    reps = rows.sparkSession.range(replicates).withColumnRenamed("id", "rep")
    u = unit_hash(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col(y).cast("string"), F.col("i").cast("string")))
    draws = table.select(y, "i", "size").join(F.broadcast(reps)).select("rep", y, F.floor(u * F.col("size")).alias("i"))
    weights = draws.groupBy("rep", y, "i").agg(F.count(F.lit(1)).alias("w"))
    drawn = weights.join(table.select(y, "i", a, b), [y, "i"])

    def area(score: str) -> DataFrame:
        each = drawn.groupBy("rep", score).agg(F.sum(F.when(F.col(y) == 1, F.col("w")).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 0, F.col("w")).otherwise(0)).alias("neg"))
        upto = each.withColumn("upto", F.sum("neg").over(Window.partitionBy("rep").orderBy(score)))
        return upto.groupBy("rep").agg((F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias(f"auc_{score}"))

    delta = area(a).join(area(b), "rep").select((F.col(f"auc_{a}") - F.col(f"auc_{b}")).alias("d"))
    return delta.agg(F.avg("d").alias("mean"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.avg((F.col("d") <= 0).cast("double")).alias("p_not_better"))


def shortcut_probe(rows: DataFrame, features: list[str], label: str, train: Column) -> DataFrame:
    """One row: test accuracy and chance level of a logistic model on standardised features, fitted where ``train`` holds."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol=label, family="multinomial", regParam=1e-3)]
    table = rows.withColumn(label, F.col(label).cast("double"))
    model = Pipeline(stages=stages).fit(table.filter(train))
    test = model.transform(table.filter(~train))
    return test.agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"), F.greatest(F.avg(label), 1 - F.avg(label)).alias("chance"), F.count(F.lit(1)).alias("n"))


def similarity_transform(xs: Column, ys: Column, xd: Column, yd: Column) -> dict[str, Column]:
    """Scale, angle and root mean square residual of the proper similarity that maps one point set to another best."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    centred = lambda a: F.transform(a, lambda v: v - mean(a))
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    x, y, u, v = centred(xs), centred(ys), centred(xd), centred(yd)
    dot, cross = total(x, u) + total(y, v), total(x, v) - total(y, u)
    size, target = total(x, x) + total(y, y), total(u, u) + total(v, v)
    strength = F.sqrt(dot * dot + cross * cross)
    return {"scale": strength / size, "angle": F.atan2(cross, dot), "residual": F.sqrt(F.greatest(F.lit(0.0), target - strength * strength / size) / F.size(xs))}
