"""Fits over a grid of settings: thresholds of the quality gate under a budget, and calibration by level, mode and alpha."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veraframe.functions.scalars import sigmoid
from veraframe.operators import decisions as D
from veraframe.operators import metrics as M
from veraframe.operators.ordering import percentiles, running
from veraframe.sources.shared import materialise


def gate_thresholds(frames: DataFrame, signals: list[str], tails: tuple[float, ...]) -> dict[float, D.Gate]:
    """A gate a tail (per cent): the low tail of sharpness and detail, the high tail of blockiness, exact and interpolated."""
    names = {i: t / 100 for i, t in enumerate(tails)}
    low = [percentiles(frames, s, {f"s{n}_{i}": q for i, q in names.items()}).drop("n") for n, s in enumerate(signals[:2])]
    high = percentiles(frames, signals[2], {f"s2_{i}": 1 - q for i, q in names.items()}).drop("n")
    row = low[0].crossJoin(low[1]).crossJoin(high).first()  # one row each; three numbers a tail
    if row is None or row["s0_0"] is None:
        raise ValueError("no frames to fit thresholds on")
    return {t: D.Gate(row[f"s0_{i}"], row[f"s1_{i}"], row[f"s2_{i}"]) for i, t in enumerate(tails)}


def threshold_sweep(frames: DataFrame, decisions: DataFrame, stages: list[D.Stage], gates: dict[float, D.Gate], signals: list[str], budget: float) -> DataFrame:
    """A row a candidate: its thresholds, the decided rate with the gate, what it loses, whether that is in the budget, chosen.

    The last candidate in the budget, in the order of ``gates``, is chosen; none may be. Decisions are written once.
    """
    table = materialise(decisions, "swept")
    base = table.agg(F.avg((F.col("verdict") != D.UNCERTAIN).cast("double")).alias("base_rate"))
    rows = []
    for nth, (tail, gate) in enumerate(gates.items()):
        seen = D.gated(frames, table, stages, gate, signals).agg(F.avg((F.col("verdict") != D.UNCERTAIN).cast("double")).alias("decided_rate"))
        given = {"nth": nth, "percentile": float(tail), "sharpness_min": gate.sharpness_min, "hf_ratio_min": gate.hf_ratio_min, "blockiness_max": gate.blockiness_max}
        rows.append(seen.select(*[F.lit(v).alias(k) for k, v in given.items()], "decided_rate"))
    out = reduce(DataFrame.unionByName, rows).crossJoin(F.broadcast(base))  # one row a candidate
    out = out.withColumn("coverage_loss", F.col("base_rate") - F.col("decided_rate")).withColumn("passes", F.col("coverage_loss") <= budget)
    out = materialise(out, "sweep")
    last = out.agg(F.max(F.when(F.col("passes"), F.col("nth"))).alias("last"))
    return out.crossJoin(F.broadcast(last)).select("percentile", "sharpness_min", "hf_ratio_min", "blockiness_max", "base_rate", "decided_rate", "coverage_loss", "passes", F.coalesce(F.col("nth") == F.col("last"), F.lit(False)).alias("chosen"))


def chosen_gate(sweep: DataFrame) -> D.Gate:
    """The gate of the chosen candidate; refuses where no candidate meets the budget."""
    row = sweep.filter("chosen").first()
    if row is None:
        raise ValueError("no percentile meets the coverage budget")
    return D.Gate(row.sharpness_min, row.hf_ratio_min, row.blockiness_max)


def _losses(rows: DataFrame, y: str, p: str, key: str) -> DataFrame:
    """One row: n, nll, brier, accuracy, ece and aurc of probabilities."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(M.point_losses(rows, y, F.col(p))).crossJoin(M.expected_calibration_error(rows, y, F.col(p))).crossJoin(M.aurc(rows, y, p, key))


def calibration_losses(scores: DataFrame, levels: list[str], y: str, key: str, part: str) -> DataFrame:
    """(level, part, scaling, temperature, n, nll, brier, accuracy, ece, aurc) on parts ``temperature`` and ``dev``, with raw
    and with scaled scores. Temperatures come from part ``temperature``."""
    out = []
    for level in levels:
        rows = scores.filter(F.col(level).isNotNull())
        t = M.fit_temperature(rows.filter(F.col(part) == "temperature"), y, level)
        for name in ("temperature", "dev"):
            some = rows.filter(F.col(part) == name)
            for scaling, by in (("raw", 1.0), ("scaled", t)):
                found = _losses(some.select(y, key, sigmoid(F.col(level) / by).alias("p")), y, "p", key)
                out.append(found.select(F.lit(level).alias("level"), F.lit(name).alias("part"), F.lit(scaling).alias("scaling"), F.lit(t).alias("temperature"), "*"))
    return reduce(DataFrame.unionByName, out)


def calibration_fits(scores: DataFrame, levels: list[str], y: str, key: str, part: str, alphas: list[float]) -> DataFrame:
    """A row a level, mode and alpha: temperature, thresholds, their evaluation on part ``dev``, and what leaving out the
    least confident would give at the same abstention (baseline_accuracy).

    Thresholds come from part ``conformal``. A fit is supported if alpha is 1 / (n + 1) at least, n being the rows of the
    class with the fewest, or of both for the marginal mode. ``supported_fits`` refuses others.
    """
    out = []
    for level in levels:
        rows = scores.filter(F.col(level).isNotNull())
        t = M.fit_temperature(rows.filter(F.col(part) == "temperature"), y, level)
        rows = rows.select(y, key, part, sigmoid(F.col(level) / t).alias("p"))
        fitted, dev = rows.filter(F.col(part) == "conformal"), rows.filter(F.col(part) == "dev")
        curve = _confident_first(dev, y, "p", key)
        n = dev.agg(F.count(F.lit(1)).alias("n_dev"))
        for mode in ("mondrian", "marginal"):
            fits = materialise(M.conformal_fit(fitted, y, "p", alphas, mondrian=mode == "mondrian"), "fits")
            sets = dev.crossJoin(F.broadcast(fits.select("alpha", "q_real", "q_fake")))  # a row an alpha
            found = _evaluated(M.prediction_sets(sets, "p", F.col("q_real"), F.col("q_fake")), y)
            found = found.crossJoin(n).withColumn("keep", F.greatest(F.lit(1), F.bround((1 - F.col("abstention")) * F.col("n_dev"))).cast("long"))
            found = F.broadcast(materialise(found, "evaluated"))
            same = curve.join(found.select("alpha", "keep"), F.col("seen") == F.col("keep")).select("alpha", (F.col("hits") / F.col("seen")).alias("baseline_accuracy"))
            few = F.least("n_real", "n_fake") if mode == "mondrian" else F.col("n_real") + F.col("n_fake")
            row = fits.join(found, "alpha", "left").join(same, "alpha", "left").drop("keep")
            out.append(row.select(F.lit(level).alias("level"), F.lit(mode).alias("mode"), F.lit(t).alias("temperature"), (F.col("alpha") * (few + 1) >= 1 - 1e-12).alias("supported"), *row.columns))
    return reduce(DataFrame.unionByName, out)


def _confident_first(rows: DataFrame, y: str, p: str, key: str) -> DataFrame:
    """(seen, hits): how many of the ``seen`` most confident rows are right."""
    right = ((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("long")
    ranked = rows.select(F.greatest(F.col(p), 1 - F.col(p)).alias("conf"), F.col(key).alias("k"), right.alias("right"))
    return running(ranked, [F.col("conf").desc(), F.col("k")], {"hits": F.col("right"), "seen": F.lit(1).cast("long")}).select("seen", "hits")


def _evaluated(sets: DataFrame, y: str) -> DataFrame:
    covered = F.when(F.col(y) == 1, F.col("in_fake")).otherwise(F.col("in_real")).cast("double")
    decided = F.col("verdict") != D.UNCERTAIN
    right = ((F.col("verdict") == D.FAKE).cast("int") == F.col(y)).cast("double")
    share = lambda what, of: F.avg(F.when(of, what))
    return sets.groupBy("alpha").agg(F.avg(covered).alias("coverage"), share(covered, F.col(y) == 0).alias("coverage_real"), share(covered, F.col(y) == 1).alias("coverage_fake"), F.avg((~decided).cast("double")).alias("abstention"), share(right, decided).alias("selective_accuracy"))


def supported_fits(fits: DataFrame) -> DataFrame:
    """``fits``; the job fails at a fit that its calibration rows can't support."""
    refused: Column = F.raise_error(F.concat(F.lit("too few calibration rows for "), "level", F.lit(" "), "mode", F.lit(" at alpha "), F.col("alpha").cast("string")))
    return fits.withColumn("q_real", F.when(F.col("supported"), F.col("q_real")).otherwise(refused.cast("double")))
