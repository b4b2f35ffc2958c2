"""Extension points: metrics as one call per group, detectors as table functions, logits of encoded images."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veraframe.operators.metrics import auroc
from veraframe.sources.shared import materialise


def _auroc(y: pd.Series, score: pd.Series) -> float | None:
    ranks, positive = score.rank(method="average"), y == 1
    n_pos, n_neg = int(positive.sum()), int((y == 0).sum())
    return float((ranks[positive].sum() - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg)) if n_pos and n_neg else None


def grouped_auroc(df: DataFrame, by: list[str], y: str, score: str, most: int = 100_000) -> DataFrame:
    """(by, auroc) with one Python call for a group of at most ``most`` rows; larger ones go by sums over the cluster."""
    sizes = materialise(df.groupBy(*[F.col(c).alias(f"of_{c}") for c in by]).agg((F.count(F.lit(1)) > most).alias("large")), "group-sizes")
    here = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by])
    sized = df.select(*by, y, score).join(sizes, here).drop(*[f"of_{c}" for c in by])
    small = sized.filter("not large").groupBy(*by).agg(F.pandas_udf(_auroc, "double")(F.col(y), F.col(score)).alias("auroc"))
    if sizes.filter("large").isEmpty():
        return small
    return small.unionByName(auroc(sized.filter("large"), y, score, by).select(*by, "auroc"))


def score_bytes(rows: DataFrame, keys: list[str], content: str, fn: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """``keys`` with logit_real, logit_fake and margin from a function of encoded images to an array of two columns."""
    picked = rows.select(*keys, content)
    kinds = ", ".join(f"`{c}` {t}" for c, t in picked.dtypes[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.asarray(fn([bytes(b) for b in pdf[content]]) if len(pdf) else np.zeros((0, 2)), np.float64)
            if out.shape != (len(pdf), 2) or not np.isfinite(out).all():
                raise ValueError("two finite logits an image are needed")
            yield pdf[keys].assign(logit_real=out[:, 0], logit_fake=out[:, 1], margin=out[:, 1] - out[:, 0])

    return picked.mapInPandas(run, f"{kinds}, logit_real double, logit_fake double, margin double")


def detect(rows: DataFrame, keys: list[str], content: str, detector: Callable[[object], Iterable[tuple[int, float]]]) -> DataFrame:
    """A row (keys, det, confidence) for each detection that the user's detector finds in ``content``."""
    picked = rows.select(*keys, content)
    kinds = ", ".join(f"`{c}` {t}" for c, t in picked.dtypes[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(*row[:-1], int(d), float(c)) for row in pdf.itertuples(index=False, name=None) for d, c in detector(row[-1])]
            yield pd.DataFrame(found, columns=[*keys, "det", "confidence"])

    return picked.mapInPandas(run, f"{kinds}, det int, confidence double")
