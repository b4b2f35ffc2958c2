"""Audits of a labelled data set: class balance and spread, lineage groups, factors that give the class away, crop leakage.

A row's class is its method, or ``original`` for real rows. Methods are a small closed vocabulary that the caller gives;
real rows are compared with each of them, so they count once a method before the first shuffle and are combined there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veraframe.operators.metrics import auroc, mean_ci
from veraframe.operators.ordering import percentiles, running

ORIGINAL = "original"


def quantile_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, n, min, p10, p25, median, p75, p90, max and mean of the values that are not null (interpolated, exact)."""
    known = df.filter(F.col(value).isNotNull())
    ends = known.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    middle = percentiles(known, value, {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}, by)
    sides = [middle[c].eqNullSafe(ends[c]) for c in by]
    return ends.join(middle, reduce(Column.__and__, sides)).select(*[ends[c] for c in by], "n", "min", "p10", "p25", "median", "p75", "p90", "max", "mean")


def resolution_shares(df: DataFrame, common: tuple[str, ...], by: list[str], width: str = "width", height: str = "height") -> DataFrame:
    """by, count, distinct_resolutions, and the share in per cent of each common resolution (``r640x480``) and of all others."""
    size = F.concat_ws("x", F.col(width).cast("string"), F.col(height).cast("string"))
    share = lambda test: 100.0 * F.count_if(test) / F.count(F.lit(1))
    named = [share(size == r).alias(f"r{r}") for r in common]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.count_distinct(size).alias("distinct_resolutions"), *named, share(~size.isin(*common)).alias("other"))


def split_balance(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """split, samples, real, fake and fake_to_real (null without real rows)."""
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col(label) == "real").alias("real"), F.count_if(F.col(label) == "fake").alias("fake"))
    return counts.withColumn("fake_to_real", F.try_divide(F.col("fake"), F.col("real")))


def originals_per_group(samples: DataFrame, groups: DataFrame) -> DataFrame:
    """(originals, groups): how many lineage groups hold how many real samples; ``groups`` is (sample_id, group_key)."""
    real = groups.join(samples.select("sample_id", (F.col("label") == "real").cast("int").alias("real")), "sample_id")
    return real.groupBy("group_key").agg(F.sum("real").alias("originals")).groupBy("originals").agg(F.count(F.lit(1)).alias("groups"))


def against_originals(df: DataFrame, cls: str, score: str, methods: tuple[str, ...], by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, method, n_pos, n_neg and auroc of each method's rows against all original rows, and of all methods as ``fake``."""
    met = F.when(F.col(cls) == ORIGINAL, F.array(*map(F.lit, (*methods, "fake")))).otherwise(F.array(F.col(cls), F.lit("fake")))
    sides = df.select(*by, score, (F.col(cls) != ORIGINAL).cast("int").alias("y"), F.explode(met).alias("method"))
    return auroc(sides, "y", score, [*by, "method"])


def factors_long(df: DataFrame, keep: list[str], factors: list[str]) -> DataFrame:
    """keep, factor and value (double), a row for each factor of each row whose value is not null."""
    cells = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("value")) for f in factors])
    return df.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.factor", "cell.value").filter("value IS NOT NULL")


def factor_rank_correlations(df: DataFrame, factors: list[str], against: list[str]) -> DataFrame:
    """factor, against, n and rho (Spearman; null below three rows, 0 without variance)."""
    others = [F.col(a).cast("double").alias(f"against_{i}") for i, a in enumerate(against)]
    names = [f"against_{i}" for i in range(len(against))]
    pairs = factors_long(df.select(*[F.col(f) for f in factors], *others), names, factors)
    cells = F.array(*[F.struct(F.lit(a).alias("against"), F.col(n).alias("other")) for a, n in zip(against, names, strict=True)])
    pairs = pairs.select("factor", "value", F.explode(cells).alias("cell")).select("factor", "value", "cell.against", "cell.other").filter("other IS NOT NULL")
    # Equal pairs count once with their number, so that a frequent value is one row in the joins with the ranks.
    pairs = pairs.groupBy("factor", "against", "value", "other").agg(F.count(F.lit(1)).alias("n"))
    by = ["factor", "against"]
    ranked = pairs.join(weighted_ranks(pairs, "value", by).withColumnRenamed("rank", "ra"), [*by, "value"]).join(weighted_ranks(pairs, "other", by).withColumnRenamed("rank", "rb"), [*by, "other"])
    total = F.sum("n")
    mean = lambda c: F.sum(F.col("n") * c) / total
    ra, rb = F.col("ra"), F.col("rb")
    spread = lambda c: mean(c * c) - mean(c) * mean(c)
    flat = (F.min(ra) == F.max(ra)) | (F.min(rb) == F.max(rb))
    both = mean(ra * rb) - mean(ra) * mean(rb)
    out = ranked.groupBy(*by).agg(total.alias("n"), flat.alias("flat"), both.alias("both"), (spread(ra) * spread(rb)).alias("spreads"))
    rho = F.when(F.col("n") >= 3, F.when(F.col("flat"), F.lit(0.0)).otherwise(F.col("both") / F.sqrt("spreads")))
    return out.select(*by, "n", rho.alias("rho"))


def weighted_ranks(pairs: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, value and the mean rank of each distinct value of rows that count ``n`` times."""
    peers = pairs.groupBy(*by, value).agg(F.sum("n").alias("peers"))
    return running(peers, [F.col(value)], {"upto": F.col("peers")}, by).select(*by, value, (F.col("upto") - (F.col("peers") - 1) / 2).alias("rank"))


def paired_differences(df: DataFrame, factors: list[str], key: str, real: str, cls: str) -> DataFrame:
    """factor, class, n, mean, low and high of a row's value less that of its matched real row (``real`` names its key)."""
    long = factors_long(df, [key, real, cls], factors)
    reals = long.filter(F.col(cls) == ORIGINAL).select(F.col(key).alias(real), "factor", F.col("value").alias("real_value"))
    diffs = long.filter(F.col(cls) != ORIGINAL).join(reals, [real, "factor"]).withColumn("difference", F.col("value") - F.col("real_value"))
    return mean_ci(diffs, "difference", ["factor", cls])


def crop_problems(crops: DataFrame, official: DataFrame, references: tuple[str, ...], key: str = "sample_id", split: str = "split") -> DataFrame:
    """(code, key): rows of one side only by (key, split), crops whose split is not the official one, and references that
    are not officially in the crop's split (an unknown one isn't). A null reference is no problem."""
    ours, theirs = crops.select(key, split), official.select(key, split)
    differ = ours.subtract(theirs).unionByName(theirs.subtract(ours)).select(F.lit("membership").alias("code"), F.col(key).alias("key"))

    def elsewhere(column: str, code: str) -> DataFrame:
        known = official.select(F.col(key).alias("found"), F.col(split).alias("found_split"))
        met = crops.filter(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).alias("wanted"), F.col(split).alias("own"))
        met = met.join(known, F.col("wanted") == F.col("found"), "left")
        return met.filter(~F.col("own").eqNullSafe(F.col("found_split"))).select(F.lit(code).alias("code"), "key")

    return reduce(DataFrame.unionByName, [differ, elsewhere(key, "split"), *[elsewhere(c, c) for c in references]])


def slot_audit(resolved: DataFrame, planned: list[int], video: str = "video_id") -> DataFrame:
    """video, member, slots, planned_slots, recovered_slots, individual_slots, failed_slots and mean_offset.

    ``resolved`` has (video, slot, mode, frames) as slot resolution gives it. A member without a frame, or with another
    frame than the planned one in a slot that failed for its family, has failed; mean_offset is over its other slots.
    """
    at = F.element_at(F.array(*map(F.lit, planned)), F.col("slot") + 1)
    rows = resolved.select(video, "slot", "mode", F.explode("frames").alias("of")).select(video, "slot", "mode", "of.member", "of.frame", at.alias("planned"))
    mode = F.when(F.col("frame").isNull(), "failed").when(F.col("frame") == F.col("planned"), "planned").otherwise(F.col("mode"))
    rows = rows.withColumn("member_mode", mode)
    is_ = lambda *names: F.col("member_mode").isin(*names)
    return rows.groupBy(video, "member").agg(
        F.count(F.lit(1)).alias("slots"),
        F.count_if(is_("planned")).alias("planned_slots"),
        F.count_if(is_("joint", "individual")).alias("recovered_slots"),
        F.count_if(is_("individual")).alias("individual_slots"),
        F.count_if(is_("failed")).alias("failed_slots"),
        F.avg(F.when(~is_("failed"), (F.col("frame") - F.col("planned")).cast("double"))).alias("mean_offset"),
    )


def condition_deltas(matrix: DataFrame, metric: str, clean: str = "clean") -> DataFrame:
    """condition, severity, metric and delta to the clean condition, for all degraded conditions of a matrix."""
    base = matrix.filter(F.col("condition") == clean).agg(F.max(metric).alias("clean"))  # one row
    rest = matrix.filter(F.col("condition") != clean)
    return rest.crossJoin(F.broadcast(base)).select("condition", "severity", metric, (F.col(metric) - F.col("clean")).alias("delta"))


def severity_summary(matrix: DataFrame, metric: str, clean: str = "clean") -> DataFrame:
    """severity (and ``all``), mean, worst and worst_condition of the degraded conditions; ties go to the first name."""
    rest = matrix.filter(F.col("condition") != clean).withColumn("severity", F.explode(F.array("severity", F.lit("all"))))
    worst = F.min(F.struct(metric, "condition"))
    return rest.groupBy("severity").agg(F.avg(metric).alias("mean"), worst[metric].alias("worst"), worst["condition"].alias("worst_condition"))


def acquisition_by_class(expected: DataFrame, found: DataFrame, cls: str = "class", stem: str = "stem") -> DataFrame:
    """A row a class of what should be there and what is: counts of each kind of problem, bytes, and the range of durations.

    ``expected`` has (class, stem); ``found`` has (class, name, bytes, readable, duration_s), a row a file. Only ``.mp4``
    files count as found. Names that begin with ``tmp`` are partial downloads; other files, and clips that are not expected,
    are unexpected. Clips without bytes aren't probed; of the others, those that can't be read are counted, and the rest
    has durations. A class without files has all its clips missing.
    """
    name = F.col("name")
    is_clip, partial = name.endswith(".mp4"), name.startswith("tmp")
    files = found.select(F.col(cls), "bytes", "duration_s", is_clip.alias("clip"), partial.alias("partial"), F.coalesce("readable", F.lit(False)).alias("readable"), F.when(is_clip, F.regexp_replace(name, r"\.mp4$", "")).alias(stem))
    both = expected.select(cls, stem).distinct().withColumn("wanted", F.lit(True)).join(files, [cls, stem], "full")
    clip, wanted, probed = F.coalesce("clip", F.lit(False)), F.coalesce("wanted", F.lit(False)), F.coalesce(F.col("clip") & (F.col("bytes") > 0), F.lit(False))
    good = F.when(probed & F.col("readable"), F.col("duration_s"))
    # Expected clips that several files have would count more than once.
    return both.groupBy(cls).agg(
        F.count_distinct(F.when(wanted, F.col(stem))).alias("expected"),
        F.count_if(clip).alias("found"),
        F.coalesce(F.sum(F.when(clip, F.col("bytes"))), F.lit(0)).alias("total_bytes"),
        F.count_if(wanted & ~clip).alias("missing"),
        F.count_if((clip & ~wanted) | (F.col("clip").isNotNull() & ~clip & ~F.col("partial"))).alias("unexpected"),
        F.count_if(clip & (F.col("bytes") == 0)).alias("zero_byte"),
        F.count_if(F.coalesce("partial", F.lit(False))).alias("partial_downloads"),
        F.count_if(probed & ~F.col("readable")).alias("unreadable"),
        F.min(good).alias("duration_s_min"),
        F.max(good).alias("duration_s_max"),
    )


def probe_histograms(found: DataFrame, cls: str = "class") -> DataFrame:
    """(class, measure, value, files): how many readable clips have which resolution and which codec."""
    read = found.filter(F.col("name").endswith(".mp4") & (F.col("bytes") > 0) & F.col("readable"))
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    cells = F.array(F.struct(F.lit("resolution").alias("measure"), size.alias("value")), F.struct(F.lit("codec").alias("measure"), F.col("codec").alias("value")))
    return read.select(cls, F.explode(cells).alias("cell")).groupBy(cls, "cell.measure", "cell.value").agg(F.count(F.lit(1)).alias("files"))
