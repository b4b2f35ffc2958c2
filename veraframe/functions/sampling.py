"""Plans of which frames of a video are looked at: evenly spaced, nested by budget, and shared by a family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FULL = 16


def frame_plan(frames: Column, most: int = FULL) -> Column:
    """Up to ``most`` distinct, ascending, evenly spaced frame numbers of a video; empty without frames or their number."""
    n = F.coalesce(frames.cast("long"), F.lit(0).cast("long"))
    m = F.least(F.lit(most).cast("long"), n)
    spaced = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(m - 1, F.lit(0).cast("long"))), lambda i: F.bround(F.try_divide(i * (n - 1), m - 1)).cast("long"))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(m == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(spaced))


def every_other(plan: Column) -> Column:
    """The plan of half the budget, whose frames are all in ``plan``."""
    return F.filter(plan, lambda _, i: i % 2 == 0)


def nested_plans(df: DataFrame, frames: str) -> DataFrame:
    """``df`` with plan_16, plan_8 and plan_4; each is in the one before."""
    out = df.withColumn("plan_16", frame_plan(F.col(frames)))
    return out.withColumn("plan_8", every_other(F.col("plan_16"))).withColumn("plan_4", every_other(F.col("plan_8")))


def family_plans(df: DataFrame, family: str, frames: str) -> DataFrame:
    """(family, members, shared, plan): the plan for the range of frames that all members have.

    A family with a member without frames (or their number), or whose range can't give 16 distinct frames, has a null plan.
    """
    known = F.min(F.coalesce(F.col(frames), F.lit(0)))
    out = df.groupBy(family).agg(F.count(F.lit(1)).alias("members"), known.alias("shared"))
    return out.withColumn("plan", F.when(F.col("shared") >= FULL, frame_plan(F.col("shared"))))
