"""Grouped metrics from merged counts against plain Python over the rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veraframe.operators import score_counts as CN


def plain(rows, alpha=0.2, bins=15):
    n, pos = len(rows), sum(y for y, _ in rows)
    pairs = [(a, b) for y, a in rows if y for z, b in rows if not z]
    auroc = sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs) if pairs else None
    ap = sum(sum(y for y, s in rows if s >= t) / sum(1 for _, s in rows if s >= t) for z, t in rows if z) / pos if pos else None
    cells = {}
    for y, s in rows:
        cells.setdefault(sum(i / bins < s for i in range(1, bins)), []).append((y, s))
    ece = sum(abs(sum(s for _, s in c) - sum(y for y, _ in c)) for c in cells.values()) / n
    k = math.ceil((n + 1) * (1 - alpha))
    return auroc, ap, ece, sorted(s for _, s in rows)[k - 1] if k <= n else 1.0


def test_metrics_of_merged_counts(spark):
    rng = random.Random(3)
    groups = {"hot": 400, "b": 30, None: 12, "one": 1, "ties": 20}
    rows = [(g, int(rng.random() < 0.4) if g != "one" else 0, 0.5 if g == "ties" else round(rng.random(), 2)) for g, n in groups.items() for _ in range(n)]
    odd = [("b", 1, None), ("b", None, 0.3), ("b", 2, 0.3)]
    df = spark.createDataFrame(rows + odd, "g string, y int, s double").withColumn("pos_", F.lit(1))
    parts = [CN.score_counts(p, ["g"], "y", "s") for p in (df.filter("s < 0.4"), df.filter("NOT s < 0.4"), df.limit(0))]
    counts = CN.merged(*parts)
    assert sorted(map(str, counts.collect())) == sorted(map(str, CN.score_counts(df, ["g"], "y", "s").collect()))
    got = [
        {r.g: r.auroc for r in CN.auroc_of(counts, ["g"]).collect()},
        {r.g: r.ap for r in CN.average_precision_of(counts, ["g"]).collect()},
        {r.g: r.ece for r in CN.calibration_error_of(counts, ["g"], F.col("score")).collect()},
        {r.g: r.q for r in CN.conformal_quantile_of(counts, ["g"], 0.2).collect()},
    ]
    for g in groups:
        want = plain([(y, s) for h, y, s in rows if h == g])
        for have, w in zip(got, want, strict=True):
            assert have[g] is None if w is None else have[g] == pytest.approx(w, abs=1e-9), (g, want)
    assert all(set(m) == set(groups) for m in got)


def test_no_rows_have_no_groups(spark):
    none = CN.score_counts(spark.createDataFrame([], "g string, y int, s double"), ["g"], "y", "s")
    assert CN.auroc_of(none, ["g"]).count() == CN.conformal_quantile_of(none, ["g"], 0.1).count() == 0
