"""Landmark geometry of families: fakes against their matched real frames, and features of a video's aligned faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veraframe.operators.metrics import mean_ci

#: Five landmarks (right eye, left eye, nose, right and left mouth corner) of an aligned face of 112 pixels.
TEMPLATE_112 = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))
POINTS = ("reye", "leye", "nose", "rmouth", "lmouth")


def template(size: int = 224, margin: float = 0.25) -> list[tuple[float, float]]:
    """The landmarks of an aligned face in a crop of ``size`` pixels with a margin."""
    scale = size / 112 / (1 + 2 * margin)
    return [tuple((v - 56) * scale + size / 2 for v in p) for p in TEMPLATE_112]


def landmark_check(frames: DataFrame) -> DataFrame:
    """(method, width, measure, n, mean, low, high): eye distance and place of fakes against the real frame they match.

    ``frames`` has family_id, slot, frame_index, label, method, source_width and landmarks lx1, ly1, ... Only pairs of one
    slot and one frame count, in which the real eyes are in order. A crop from the centre leaves the ratio at 1 and the
    shift at 0; a squeezed picture has the predicted ratio.
    """
    eye = {"gap": F.col("lx2") - F.col("lx1"), "mid": (F.col("lx1") + F.col("lx2")) / 2}
    side = lambda label, p: frames.filter(F.col("label") == label).select("family_id", "slot", "frame_index", F.col("method").alias(f"{p}method"), F.col("source_width").alias(f"{p}width"), *[v.alias(f"{p}{k}") for k, v in eye.items()])
    pairs = side("fake", "f_").join(side("real", "r_"), ["family_id", "slot", "frame_index"]).filter("r_gap > 0")
    values = {
        "interocular_ratio": F.col("f_gap") / F.col("r_gap"),
        "eye_mid_shift": F.col("f_mid") - F.col("r_mid") + (F.col("r_width") - F.col("f_width")) / 2,
        "squeeze_predicted_ratio": F.col("f_width") / F.col("r_width"),
    }
    width = F.when(F.col("f_width") == F.col("r_width"), "same").otherwise("changed")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value")) for k, v in values.items()]))
    return mean_ci(pairs.select(F.col("f_method").alias("method"), width.alias("width"), each.alias("m")).select("method", "width", "m.measure", "m.value"), "value", ["method", "width", "measure"])


def geometry_features(frames: DataFrame, by: list[str], points: list[tuple[float, float]]) -> DataFrame:
    """Per key the means of a face's proportions and of its landmarks' distances from the template.

    ``frames`` has aligned landmarks lx1, ly1, ... and the detector's box (w, h).
    """
    x, y = (lambda i: F.col(f"lx{i}")), (lambda i: F.col(f"ly{i}"))
    apart, middle = x(2) - x(1), (x(1) + x(2)) / 2
    height = (y(4) + y(5)) / 2 - (y(1) + y(2)) / 2
    feats: dict[str, Column] = {"width_height_ratio": apart / height, "mouth_to_eye_width": (x(5) - x(4)) / apart, "nose_x_offset": (x(3) - middle) / apart, "detector_box_aspect": F.col("w") / F.col("h")}
    for i, (name, (px, py)) in enumerate(zip(POINTS, points, strict=True), 1):
        feats |= {f"residual_{name}_x": x(i) - px, f"residual_{name}_y": y(i) - py}
    return frames.groupBy(*by).agg(*[F.avg(v).alias(k) for k, v in feats.items()])


def paired_differences(features: DataFrame, family: str, label: str, by: list[str], names: list[str]) -> DataFrame:
    """(by, feature, n, mean, low, high): each fake's features less those of its family's real, of which there is one."""
    real = features.filter(F.col(label) == "real").select(family, *[F.col(c).alias(f"real_{c}") for c in names])
    both = features.filter(F.col(label) == "fake").join(real, family)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) - F.col(f"real_{c}")).alias("value")) for c in names]))
    return mean_ci(both.select(*by, each.alias("m")).select(*by, "m.feature", "m.value"), "value", [*by, "feature"])
