"""Column functions: numerics, hashes, boxes and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column | str, clip: float = 60.0) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), x)))))


def nll(y: Column, p: Column, eps: float = 1e-12) -> Column:
    """Negative log-likelihood of a binary label; ``eps`` keeps the logarithm finite."""
    return -F.when(y == 1, F.log(p + eps)).otherwise(F.log(1 - p + eps))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def distillation_loss(y: Column, student: Column, teacher: Column, alpha: float = 0.5, temperature: float = 2.0) -> Column:
    """(1 - a) * BCE(label) + a * T^2 * BCE(sigmoid(teacher / T)), both from the student's logit."""
    hard = softplus(student) - y * student
    soft_target, soft = sigmoid(teacher / temperature), student / temperature
    return (1 - alpha) * hard + alpha * temperature**2 * (softplus(soft) - soft_target * soft)


def unit_hash(text: Column) -> Column:
    """A stable number in [0, 1): the first 52 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def unit_hash_le(text: Column) -> Column:
    """A stable number in [0, 1] from the first eight bytes of SHA-256, the lowest first."""
    digest = F.sha2(text, 256)
    swapped = F.concat(*[F.substring(digest, i, 2) for i in range(15, 0, -2)])
    return F.conv(swapped, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def iou(x1, y1, w1, h1, x2, y2, w2, h2) -> Column:
    """Intersection over union of two boxes given as left, top, width and height; 0 for empty ones."""
    a = [F.col(c) if isinstance(c, str) else c for c in (x1, y1, w1, h1, x2, y2, w2, h2)]
    wide = F.greatest(F.lit(0.0), F.least(a[0] + a[2], a[4] + a[6]) - F.greatest(a[0], a[4]))
    high = F.greatest(F.lit(0.0), F.least(a[1] + a[3], a[5] + a[7]) - F.greatest(a[1], a[5]))
    both = wide * high
    union = a[2] * a[3] + a[6] * a[7] - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def area(w: Column, h: Column) -> Column:
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def expanded(x: Column, y: Column, w: Column, h: Column, margin: float) -> tuple[Column, Column, Column, Column]:
    """The box with ``margin`` of its width and height added on each side."""
    return x - w * margin, y - h * margin, w * (1 + 2 * margin), h * (1 + 2 * margin)


def clipped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """The part of the box that lies in an image; a box outside has no width or height."""
    within = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    left, top = within(x, width), within(y, height)
    return left, top, F.greatest(F.lit(0.0), within(x + w, width) - left), F.greatest(F.lit(0.0), within(y + h, height) - top)


#: The buckets' names, the resolutions and heights that have names, and what looks like a URL.
DURATIONS = ((10, "<10s"), (20, "10-20s"), (30, "20-30s"), (45, "30-45s"))
LONGEST = ">=45s"
RESOLUTIONS = ("1280x720", "640x480", "1920x1080", "854x480")
HEIGHTS = (480, 720, 1080)
URLISH = r"(?i)^[a-z][a-z0-9+.-]*:|^//|^www\."


def duration_bucket(seconds: Column) -> Column:
    """The bucket of a length in seconds; its upper bound belongs to the next. Null for a null or negative length."""
    out = F.when(seconds.isNull() | (seconds < 0), None)
    for bound, name in DURATIONS:
        out = out.when(seconds < bound, name)
    return out.otherwise(LONGEST)


def resolution_bucket(width: Column, height: Column) -> Column:
    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    return F.when(size.isin(*RESOLUTIONS), size).when(height.isin(*HEIGHTS), F.concat(F.lit("other-"), height.cast("string"), F.lit("p"))).otherwise("other")


def display_safe(text: Column, most: int = 120) -> Column:
    """Text for display, or null: control, format and other such characters go, space is collapsed, what is too long is cut.

    A text that begins like a URL, and one of which nothing is left, is null.
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"\p{C}", ""), r"\p{Z}+", " "))
    cut = F.concat(F.substring(plain, 1, most), F.when(F.length(plain) > most, "…").otherwise(""))
    return F.when((plain != "") & ~plain.rlike(URLISH), cut)


def average_hash(grid: Column) -> Column:
    """64 bits, as an array of 0 and 1: whether a value of an 8 x 8 grid is above the grid's mean."""
    mean = F.aggregate(grid, F.lit(0.0), lambda acc, v: acc + v.cast("double")) / F.size(grid)
    return F.transform(grid, lambda v: (v.cast("double") > mean).cast("int"))


def bits_to_long(bits: Column) -> Column:
    """A 64-bit number from 64 bits, the first being the highest."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("long")))


def frame_rate(rate: Column) -> Column:
    """Frames a second from ``30000/1001`` or a plain number; null where it has no value."""
    parts = F.split(rate, "/")
    return F.when(F.size(parts) == 2, F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))).otherwise(rate.try_cast("double"))
