"""Staged verdicts on videos from frame logits, the downgrade-only quality gate, and what is reported about them.

A video has up to ``FULL`` slots. Stage k uses the slots that are multiples of ``FULL / k``; it exists only if all of them
do. Stages are tried in order, and the first one whose prediction set has a single class decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veraframe.functions.scalars import sigmoid

FULL = 16
REAL, FAKE, UNCERTAIN = "likely_real", "likely_manipulated", "uncertain"


@dataclass(frozen=True)
class Stage:
    """Calibration of one stage: temperature, level and class thresholds."""

    k: int
    alpha: float
    temperature: float
    q_real: float
    q_fake: float


@dataclass(frozen=True)
class Gate:
    """Thresholds of the quality checks; ``noise_max`` and ``face_px_min`` are optional checks."""

    sharpness_min: float
    hf_ratio_min: float
    blockiness_max: float
    noise_max: float | None = None
    face_px_min: float | None = None
    majority: float = 0.5

    def flags(self, sharpness: Column, hf_ratio: Column, blockiness: Column, noise: Column | None = None) -> dict[str, Column]:
        out = {"LOW_SHARPNESS": sharpness < self.sharpness_min, "LOW_RESOLUTION": hf_ratio < self.hf_ratio_min, "HIGH_COMPRESSION": blockiness > self.blockiness_max}
        if self.noise_max is not None and noise is not None:
            out["HIGH_NOISE"] = noise > self.noise_max
        return out


def in_stage(slot: Column, k: int) -> Column:
    return slot % (FULL // k) == 0


def stage_scores(frames: DataFrame, ks: list[int], video: str = "sample_id", slot: str = "slot", logit: str = "logit", keep: list[str] = []) -> DataFrame:  # noqa: B006
    """One row per video: score_k (mean logit of stage k, null if a slot is missing) for each k, and n_frames."""
    scores = []
    for k in ks:
        hit = in_stage(F.col(slot), k)
        scores.append(F.when(F.count_if(hit) == k, F.avg(F.when(hit, F.col(logit)))).alias(f"score_{k}"))
    return frames.groupBy(video, *keep).agg(*scores, F.count(F.lit(1)).alias("n_frames"))


def decide(p: Column, stage: Stage) -> tuple[Column, Column]:
    """(real in set, fake in set) of a stage."""
    return p <= stage.q_real, (1 - p) <= stage.q_fake


def _verdict(real: Column, fake: Column) -> Column:
    return F.when(real & ~fake, REAL).when(fake & ~real, FAKE).otherwise(UNCERTAIN)


def adaptive(scores: DataFrame, stages: list[Stage]) -> DataFrame:
    """Adds p_k and code_k of every stage, and reason, frames_used, final_stage, p_fake, confidence, in_real, in_fake, verdict.

    A stage's code is missing, real, fake, both or empty: its prediction set, if all its slots are there.
    """
    out = scores
    for s in stages:
        p = sigmoid(F.col(f"score_{s.k}") / s.temperature)
        real, fake = decide(F.col(f"p_{s.k}"), s)
        code = F.when(F.col(f"p_{s.k}").isNull(), "missing").when(real & ~fake, "real").when(fake & ~real, "fake").when(real, "both").otherwise("empty")
        out = out.withColumn(f"p_{s.k}", p).withColumn(f"code_{s.k}", code)
    ks, last = [s.k for s in stages], stages[-1].k
    stop = F.lit(len(ks))
    for i in range(len(ks) - 1, 0, -1):
        stop = F.when(F.col(f"code_{ks[i - 1]}").isin("missing", "real", "fake"), i).otherwise(stop)
    out = out.withColumn("__stop", stop)
    out = out.withColumn("__code", F.element_at(F.array(*[F.col(f"code_{k}") for k in ks]), F.col("__stop")))
    k = F.element_at(F.array(*map(F.lit, ks)), F.col("__stop"))
    before = F.element_at(F.array(F.lit(0), *map(F.lit, ks)), F.col("__stop"))
    missing, single = F.col("__code") == "missing", F.col("__code").isin("real", "fake")
    name = k.cast("string")
    reason = (
        F.when(missing, F.concat(F.lit("insufficient_frames_for_k"), name))
        .when(k != last, F.concat(F.lit("confident_singleton_k"), name))
        .when(single, F.lit(f"final_k{last}_singleton"))
        .otherwise(F.concat(F.lit(f"final_k{last}_uncertain_"), F.col("__code")))
    )
    out = out.withColumns({"reason": reason, "frames_used": F.when(missing, before).otherwise(k)})
    # Where frames ran out, the last decided stage was ambiguous, and its probability stands.
    used = F.col("frames_used")
    p_fake, code = F.lit(None).cast("double"), F.lit(None).cast("string")
    for s in stages:
        p_fake, code = F.when(used == s.k, F.col(f"p_{s.k}")).otherwise(p_fake), F.when(used == s.k, F.col(f"code_{s.k}")).otherwise(code)
    out = out.withColumns({"final_stage": used, "p_fake": p_fake, "in_real": code.isin("real", "both"), "in_fake": code.isin("fake", "both")})
    verdict = F.when(F.col("__code") == "real", REAL).when(F.col("__code") == "fake", FAKE).otherwise(UNCERTAIN)
    out = out.withColumns({"verdict": verdict, "confidence": F.coalesce(F.greatest(F.col("p_fake"), 1 - F.col("p_fake")), F.lit(0.0))})
    return out.drop("__stop", "__code")


def fixed(scores: DataFrame, stage: Stage) -> DataFrame:
    """The decision of one stage alone: p_fake, verdict; rows without the stage are left out."""
    out = scores.filter(F.col(f"score_{stage.k}").isNotNull()).withColumn("p_fake", sigmoid(F.col(f"score_{stage.k}") / stage.temperature))
    real, fake = decide(F.col("p_fake"), stage)
    return out.withColumns({"in_real": real, "in_fake": fake, "verdict": _verdict(real, fake), "frames_used": F.lit(stage.k)})


def gated(frames: DataFrame, decisions: DataFrame, stages: list[Stage], gate: Gate, signals: list[str], video: str = "sample_id", slot: str = "slot", logit: str = "logit", face_px: str | None = None) -> DataFrame:
    """The gate: sample_id, base_verdict, verdict, gated, reasons, frames_used, passing_frames and failing fractions.

    Only used frames count. A check that a majority of them fails is a reason. Else, where some fail, the stage decides
    again on the passing frames; another outcome is the reason QUALITY_DEPENDENT, with the checks that failed at all. A
    decided verdict with a reason becomes uncertain; no other change is possible.
    """
    flags = gate.flags(*[F.col(c) for c in signals])
    base = decisions.select(video, F.col("verdict").alias("base_verdict"), "final_stage", "frames_used")
    used = frames.join(base, video).filter((F.col("frames_used") > 0) & (F.col(slot) % F.expr(f"{FULL} div greatest(frames_used, 1)") == 0))
    used = used.withColumns({f"__{c}": f for c, f in flags.items()})
    bad = reduce(lambda a, b: a | b, [F.col(f"__{c}") for c in flags])
    facts = used.groupBy(video).agg(
        *[F.avg(F.col(f"__{c}").cast("double")).alias(f"frac_{c.lower()}") for c in flags],
        F.count_if(~bad).alias("passing_frames"),
        F.count_if(bad).alias("bad_frames"),
        F.avg(F.when(~bad, F.col(logit))).alias("good_score"),
        *([F.min(face_px).alias("face_px")] if face_px else []),
    )
    out = base.join(facts, video, "left")
    checks = [F.when(F.col(f"frac_{c.lower()}") >= gate.majority, F.lit(c)) for c in flags]
    if face_px and gate.face_px_min is not None:
        checks.append(F.when(F.col("face_px") < gate.face_px_min, F.lit("SMALL_FACE")))
    out = out.withColumn("majority_reasons", F.array_compact(F.array(*checks)))
    again = None
    for s in stages:
        p = sigmoid(F.col("good_score") / s.temperature)
        again = (F if again is None else again).when(F.col("final_stage") == s.k, _verdict(*decide(p, s)))
    same = F.coalesce(again == F.col("base_verdict"), F.lit(False))
    decided = F.col("base_verdict") != UNCERTAIN
    depends = decided & (F.size("majority_reasons") == 0) & (F.coalesce(F.col("bad_frames"), F.lit(0)) > 0) & ~same
    seen = F.array_compact(F.array(F.lit("QUALITY_DEPENDENT"), *[F.when(F.col(f"frac_{c.lower()}") > 0, F.lit(c)) for c in flags]))
    out = out.withColumn("reasons", F.when(depends, seen).otherwise(F.coalesce("majority_reasons", F.array().cast("array<string>"))))
    out = out.withColumn("gated", decided & (F.size("reasons") > 0))
    return out.withColumn("verdict", F.when(F.col("gated"), UNCERTAIN).otherwise(F.col("base_verdict"))).drop("majority_reasons", "good_score", "bad_frames")


def verdict_summary(decisions: DataFrame, y: str = "y", by: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts and rates of verdicts; a rate is null where it has no base."""
    verdict, real, fake = F.col("verdict"), F.col(y) == 0, F.col(y) == 1
    decided = verdict != UNCERTAIN
    right = ((verdict == FAKE) == fake).cast("double")
    share = lambda what, of: F.avg(F.when(of, what.cast("double")))
    return decisions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(decided).alias("decided"),
        F.avg((~decided).cast("double")).alias("abstention"),
        F.avg(F.when(decided, right)).alias("decided_accuracy"),
        share(verdict == FAKE, real).alias("false_positive_rate"),
        share(verdict == FAKE, fake).alias("detection_rate"),
        share(verdict == REAL, fake).alias("miss_rate"),
        F.avg("frames_used").alias("avg_frames"),
    )


#: Why a verdict is uncertain, by the stop reason.
UNCERTAINTY = {"both": "AMBIGUOUS_EVIDENCE", "empty": "ATYPICAL_INPUT"}
TOO_FEW = "INSUFFICIENT_FACE_FRAMES"


def uncertainty_code(reason: Column) -> Column:
    """The code of an uncertain verdict's stop reason."""
    code = F.when(reason.startswith("insufficient"), TOO_FEW)
    for end, name in UNCERTAINTY.items():
        code = code.when(reason == f"final_k{FULL}_uncertain_{end}", name)
    return code.otherwise(UNCERTAINTY["both"])


def timeline(frames: DataFrame, decisions: DataFrame, video: str = "sample_id", slot: str = "slot") -> DataFrame:
    """The frames that a decision used, with the decision's verdict, final_stage and score of that stage."""
    score = F.lit(None).cast("double")
    for k in (int(c.removeprefix("score_")) for c in decisions.columns if c.startswith("score_")):
        score = F.when(F.col("final_stage") == k, F.col(f"score_{k}")).otherwise(score)
    used = decisions.filter("frames_used > 0").select(video, "verdict", "frames_used", score.alias("stage_score"))
    return frames.join(used, video).filter(F.col(slot) % F.expr(f"{FULL} div greatest(frames_used, 1)") == 0)


def evidence(frames: DataFrame, decisions: DataFrame, most: int = 4, video: str = "sample_id", slot: str = "slot", logit: str = "logit") -> DataFrame:
    """(video, evidence, sign): the ``most`` used frames that speak most for the verdict, in slot order.

    The sign is that of the verdict, or of the last stage's score where the verdict is uncertain; ties go by slot.
    """
    sign = F.when(F.col("verdict") == FAKE, 1).when(F.col("verdict") == REAL, -1).when(F.col("stage_score") >= 0, 1).otherwise(-1)
    used = timeline(frames, decisions, video, slot).withColumn("sign", sign)
    top = used.withColumn("rank", F.row_number().over(Window.partitionBy(video).orderBy(-F.col("sign") * F.col(logit), F.col(slot)))).filter(F.col("rank") <= most)
    return top.groupBy(video).agg(F.array_sort(F.collect_list(F.struct(F.col(slot).alias("slot"), F.round(F.col(logit), 6).alias("logit")))).alias("evidence"), F.first("sign").alias("sign"))


def best_epoch(log: DataFrame, run: str, epoch: str, metric: str, patience: int, loss: str | None = None) -> DataFrame:
    """(run, best_epoch, best_metric, stopped_at): the best epoch seen before ``patience`` epochs brought nothing better.

    Among epochs of one metric the one with the smaller ``loss`` is better, then the earlier. ``stopped_at`` is the epoch
    at which patience ran out, or null.
    """
    value = F.struct(F.col(metric).alias("metric"), (-F.col(loss) if loss else F.lit(0)).alias("gain"))
    by_run = Window.partitionBy(run).orderBy(epoch)
    upto = by_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = log.select(run, epoch, value.alias("value")).withColumn("best", F.max("value").over(upto))
    is_best = F.coalesce(F.lag("best").over(by_run) < F.col("value"), F.lit(True))
    seen = seen.withColumn("best_at", F.max(F.when(is_best, F.col(epoch))).over(upto)).withColumn("since", F.col(epoch) - F.col("best_at"))
    stop = seen.groupBy(run).agg(F.min(F.when(F.col("since") >= patience, F.col(epoch))).alias("stopped_at"))
    live = seen.join(stop, run).filter(F.col("stopped_at").isNull() | (F.col(epoch) <= F.col("stopped_at")))
    return live.groupBy(run).agg(F.max("best_at").alias("best_epoch"), F.max("best.metric").alias("best_metric"), F.first("stopped_at").alias("stopped_at"))


def decision_agreement(a: DataFrame, b: DataFrame, video: str = "sample_id", y: str = "y") -> DataFrame:
    """One row on two variants' decisions of the same videos: n, how often verdicts and used frames agree, and in how many
    real videos each, and only the second, sees a fake. Videos that one variant lacks count in ``unmatched`` alone."""
    left = a.select(video, F.col(y).alias("y"), F.col("verdict").alias("va"), F.col("frames_used").alias("ka"))
    both = left.join(b.select(video, F.col("verdict").alias("vb"), F.col("frames_used").alias("kb")), video, "full")
    met, real = F.col("va").isNotNull() & F.col("vb").isNotNull(), F.col("y") == 0
    share = lambda c: F.avg(F.when(met, c.cast("double")))
    accused = lambda c: F.col(c) == FAKE
    return both.agg(
        F.count_if(met).alias("n"),
        F.count_if(~met).alias("unmatched"),
        share(F.col("va") == F.col("vb")).alias("verdict_agreement"),
        share(F.col("ka") == F.col("kb")).alias("frames_agreement"),
        F.count_if(met & real & accused("va")).alias("false_accusations_a"),
        F.count_if(met & real & accused("vb")).alias("false_accusations_b"),
        F.count_if(met & real & accused("vb") & ~accused("va")).alias("new_false_accusations"),
    )
