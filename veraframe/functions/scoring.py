"""Scoring extension points: a user's scorer runs on Arrow batches, once per frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veraframe.operators.decisions import Stage, adaptive, in_stage, stage_scores

Scorer = Callable[[np.ndarray], np.ndarray]


def score_frames(frames: DataFrame, features: str, scorer: Scorer, keys: list[str], out: str = "logit") -> DataFrame:
    """``keys`` with the scorer's logit; a wrong count or a number that is not finite fails the task."""
    picked = frames.select(*keys, features)
    kinds = ", ".join(f"`{c}` {t}" for c, t in picked.dtypes[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = np.asarray(scorer(np.stack(pdf[features].to_numpy())) if len(pdf) else [], np.float64)
            if values.shape != (len(pdf),) or not np.isfinite(values).all():
                raise ValueError("a scorer must return one finite number a frame")
            yield pdf[keys].assign(**{out: values})

    return picked.mapInPandas(run, f"{kinds}, `{out}` double")


def score_in_waves(frames: DataFrame, features: str, scorer: Scorer, stages: list[Stage], video: str = "sample_id", slot: str = "slot") -> DataFrame:
    """Decisions with as few frames scored as they need: each wave scores the next stage's new slots of undecided videos."""
    from veraframe.sources.shared import materialise

    scored, todo, taken = None, frames, None
    for s in stages:
        new = in_stage(F.col(slot), s.k) if taken is None else in_stage(F.col(slot), s.k) & ~in_stage(F.col(slot), taken)
        wave = materialise(score_frames(todo.filter(new), features, scorer, [video, slot]), "wave")
        scored, taken = wave if scored is None else scored.unionByName(wave), s.k
        upto = [x for x in stages if x.k <= s.k]
        state = adaptive(stage_scores(scored, [x.k for x in stages], video, slot), stages)
        if s is not stages[-1]:
            open_ids = materialise(state.filter(F.col(f"code_{upto[-1].k}").isin("both", "empty") & F.col("reason").startswith("insufficient")).select(video), "wave-open")
            todo = todo.join(open_ids, video, "left_semi")
    return adaptive(stage_scores(scored, [x.k for x in stages], video, slot), stages)
