"""Seeded plans of training augmentation: which operations a row gets in an epoch, and how strong they are.

A plan is columns only; applying it to pictures is another step. Every draw is a hash of seed, epoch, operation and key, so
a plan can be made again anywhere, and an operation that is not drawn shifts no other one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veraframe.functions.scalars import unit_hash

#: Probability, mild end and moderate end of each operation, and the curriculum's start and length in epochs.
GAMMA = (0.3, 0.05, 0.22)
RESIZE = (0.3, 0.9, 0.45)
BLUR = (0.2, 0.3, 1.5)
NOISE = (0.2, 1.0, 8.0)
JPEG = (0.35, 90.0, 40.0)
H264 = (0.3, 22.0, 36.0)
CURRICULUM_START = 0.5
CURRICULUM_EPOCHS = 4


def severity_cap(epoch: Column, start: float = CURRICULUM_START, epochs: int = CURRICULUM_EPOCHS) -> Column:
    """The largest severity of an epoch: from ``start`` up to 1 after ``epochs`` epochs; 0 before the first one (evaluation)."""
    ramp = F.lit(1.0) if epochs <= 0 else F.least(F.lit(1.0), start + (1 - start) * epoch / epochs)
    return F.when(epoch < 0, F.lit(0.0)).when(epoch >= 0, ramp)


def augmentation_plan(df: DataFrame, key: str, epoch: str, seed: int) -> DataFrame:
    """``df`` with severity_cap, gamma, resize, blur, noise, jpeg and h264_qp: an operation's parameter, null if not drawn.

    JPEG and H.264 exclude each other. Labels play no part. Rows of a null or negative epoch get no operation.
    """
    cap = severity_cap(F.col(epoch))
    draw = lambda op, what: unit_hash(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string"), F.lit(op), F.lit(what), F.col(key).cast("string")))

    def strength(op: str, ends: tuple[float, float, float]) -> Column:
        return ends[1] + (ends[2] - ends[1]) * draw(op, "severity") * cap

    def drawn(op: str, ends: tuple[float, float, float], value: Column) -> Column:
        return F.when((F.col(epoch) >= 0) & (draw(op, "gate") < ends[0]), value)

    sign = F.when(draw("gamma", "sign") < 0.5, 1.0).otherwise(-1.0)
    coded = draw("codec", "gate")
    plan = {
        "severity_cap": cap,
        "gamma": drawn("gamma", GAMMA, F.exp(sign * strength("gamma", GAMMA))),
        "resize": drawn("resize", RESIZE, strength("resize", RESIZE)),
        "blur": drawn("blur", BLUR, strength("blur", BLUR)),
        "noise": drawn("noise", NOISE, strength("noise", NOISE)),
        "jpeg": drawn("codec", JPEG, F.bround(strength("jpeg", JPEG)).cast("int")),
        "h264_qp": F.when((F.col(epoch) >= 0) & (coded >= JPEG[0]) & (coded < JPEG[0] + H264[0]), strength("h264_qp", H264)),
    }
    return df.withColumns(plan)
