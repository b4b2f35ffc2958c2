"""Queries over the audits of a data set: clips with the measures of their media, frames, and lineage groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veraframe.operators import audits as A
from veraframe.operators import manifests as M
from veraframe.operators import tracking as T
from veraframe.operators.metrics import auroc, confusion
from veraframe.plans.manifest_queries import grouped
from veraframe.plans.media_queries import PLAN_COUNT, PLANNED, TRIES
from veraframe.plans.registry import registry

QUERIES, ORACLES, query = registry()

METHODS = ("m1", "m2", "m3", "m4", "m9")
FRAME_METHODS = ("m1", "m3")
FACTORS = ["width", "frame_count", "duration_s"]
AGAINST = ["height", "duration_s"]

MEASURED = """, mm AS (SELECT c.sample_id, c.parent_sample_id, c.label, c.official_split AS split, coalesce(c.method, 'original') AS class, m.width, m.height, m.frame_count, m.duration_s FROM clips c JOIN media m ON c.sample_id = 'c:' || CAST(m.media_id AS VARCHAR))"""
LONG = MEASURED + """, fl AS (SELECT sample_id, parent_sample_id, class, 'width' AS factor, CAST(width AS DOUBLE) AS value, height, duration_s FROM mm UNION ALL SELECT sample_id, parent_sample_id, class, 'frame_count', CAST(frame_count AS DOUBLE), height, duration_s FROM mm UNION ALL SELECT sample_id, parent_sample_id, class, 'duration_s', duration_s, height, duration_s FROM mm)"""


def measured(get) -> DataFrame:
    media = get("media").select(F.concat(F.lit("c:"), F.col("media_id").cast("string")).alias("sample_id"), "width", "height", "frame_count", "duration_s")
    clips = get("clips").select("sample_id", "parent_sample_id", "label", F.col("official_split").alias("split"), F.coalesce("method", F.lit(A.ORIGINAL)).alias("class"))
    return clips.join(media, "sample_id")


@query("a7_class_durations", "clips media", MEASURED + """ SELECT split, class, count(*) AS n, min(duration_s) AS min, quantile_cont(duration_s, 0.1) AS p10, quantile_cont(duration_s, 0.25) AS p25, quantile_cont(duration_s, 0.5) AS median, quantile_cont(duration_s, 0.75) AS p75, quantile_cont(duration_s, 0.9) AS p90, max(duration_s) AS max, round(avg(duration_s), 8) AS mean FROM mm GROUP BY split, class""")
def _(get):
    return A.quantile_summary(measured(get), "duration_s", ["split", "class"])


@query("a7_resolution_shares", "clips media", MEASURED + """, z AS (SELECT *, width || 'x' || height AS size FROM mm) SELECT split, class, count(*) AS count, count(DISTINCT size) AS distinct_resolutions, round(100.0 * count(*) FILTER (size = '1280x720') / count(*), 8) AS r1280x720, round(100.0 * count(*) FILTER (size = '640x480') / count(*), 8) AS r640x480, round(100.0 * count(*) FILTER (size NOT IN ('1280x720', '640x480')) / count(*), 8) AS other FROM z GROUP BY split, class""")
def _(get):
    return A.resolution_shares(measured(get), ("1280x720", "640x480"), ["split", "class"])


@query("a7_split_balance", "clips", "SELECT official_split AS split, count(*) AS samples, count(*) FILTER (label = 'real') AS real, count(*) FILTER (label = 'fake') AS fake, round(count(*) FILTER (label = 'fake') / nullif(count(*) FILTER (label = 'real'), 0), 8) AS fake_to_real FROM clips GROUP BY 1")
def _(get):
    return A.split_balance(get("clips").withColumnRenamed("official_split", "split"))


@query("a21_originals_per_group")
def _(get):
    return A.originals_per_group(get("samples"), M.leakage_groups(get("samples")))


ORACLES["a21_originals_per_group"] = grouped(", c AS (SELECT group_key, count(*) FILTER (s.label = 'real') AS originals FROM src JOIN g ON src.h = g.node JOIN samples s ON s.sample_id = src.sample_id GROUP BY 1) SELECT originals, count(*) AS groups FROM c GROUP BY originals")

#: Mid-rank areas of the scored sides in ``sd`` (group, y, score), written as rank sums.
AREAS = """, rk AS (SELECT grp, y, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS r FROM sd),
ar AS (SELECT grp, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, sum(r) FILTER (y = 1) AS rs FROM rk GROUP BY grp)"""
AREA = "round((rs - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos * n_neg, 0), 8) AS auroc"


@query("a20_method_auroc", "frames", ", me AS (SELECT unnest(['m1', 'm3', 'fake']) AS grp), sd AS (SELECT grp, 0 AS y, logit AS score FROM frames, me WHERE method = 'original' UNION ALL SELECT method, 1, logit FROM frames WHERE method <> 'original' UNION ALL SELECT 'fake', 1, logit FROM frames WHERE method <> 'original')" + AREAS + f" SELECT grp AS method, n_pos, n_neg, {AREA} FROM ar")
def _(get):
    return A.against_originals(get("frames"), "method", "logit", FRAME_METHODS)


@query("a20_video_auroc", "frames", ", v AS (SELECT sample_id, max(y) AS y, avg(logit) AS score FROM frames GROUP BY 1), sd AS (SELECT 'all' AS grp, y, score FROM v)" + AREAS + f" SELECT {AREA}, n_pos, n_neg FROM ar")
def _(get):
    videos = get("frames").groupBy("sample_id").agg(F.max("y").alias("y"), F.avg("logit").alias("score"))
    return auroc(videos, "y", "score").select("auroc", "n_pos", "n_neg")


@query("a20_frame_accuracy", "frames", "SELECT method, count(*) AS n, round(avg(CASE WHEN (logit > 0) = (y = 1) THEN 1.0 ELSE 0.0 END), 8) AS accuracy, round(avg(1 / (1 + exp(-logit))), 8) AS mean_p FROM frames GROUP BY method")
def _(get):
    f = get("frames")
    right = confusion(f, "y", F.col("logit") > 0, ["method"]).select("method", "accuracy")
    p = f.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg(1 / (1 + F.exp(-F.col("logit")))).alias("mean_p"))
    return right.join(p, "method")


@query("m23_factor_auroc", "clips media", LONG + ", me AS (SELECT unnest(['m1', 'm2', 'm3', 'm4', 'm9', 'fake']) AS method), sd AS (SELECT factor || '/' || method AS grp, 0 AS y, value AS score FROM fl, me WHERE class = 'original' UNION ALL SELECT factor || '/' || class, 1, value FROM fl WHERE class <> 'original' UNION ALL SELECT factor || '/fake', 1, value FROM fl WHERE class <> 'original')" + AREAS + f" SELECT split_part(grp, '/', 1) AS factor, split_part(grp, '/', 2) AS method, n_pos, n_neg, {AREA} FROM ar")
def _(get):
    return A.against_originals(A.factors_long(measured(get), ["class"], FACTORS), "class", "value", METHODS, ["factor"])


@query("m23_factor_means", "clips media", LONG + " SELECT factor, class, count(*) AS n, round(avg(value), 8) AS mean FROM fl GROUP BY factor, class")
def _(get):
    return A.factors_long(measured(get), ["class"], FACTORS).groupBy("factor", "class").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@query("m23_factor_correlations", "clips media", LONG + """, pr AS (SELECT factor, value, 'height' AS against, CAST(height AS DOUBLE) AS other FROM fl UNION ALL SELECT factor, value, 'duration_s', duration_s FROM fl),
rr AS (SELECT factor, against, rank() OVER (PARTITION BY factor, against ORDER BY value) + (count(*) OVER (PARTITION BY factor, against, value) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY factor, against ORDER BY other) + (count(*) OVER (PARTITION BY factor, against, other) - 1) / 2.0 AS rb FROM pr)
SELECT factor, against, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN CASE WHEN min(ra) = max(ra) OR min(rb) = max(rb) THEN 0.0 ELSE corr(ra, rb) END END, 8) AS rho FROM rr GROUP BY factor, against""")
def _(get):
    return A.factor_rank_correlations(measured(get), FACTORS, AGAINST)


@query("m23_paired_differences", "clips media", LONG + ", d AS (SELECT f.factor, f.class, f.value - r.value AS d FROM fl f JOIN fl r ON r.factor = f.factor AND r.sample_id = f.parent_sample_id AND r.class = 'original' WHERE f.class <> 'original') SELECT factor, class, count(*) AS n, round(avg(d), 8) AS mean, round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)), 8) AS low, round(avg(d) + 1.96 * stddev_samp(d) / sqrt(count(*)), 8) AS high FROM d GROUP BY factor, class")
def _(get):
    return A.paired_differences(measured(get), FACTORS, "sample_id", "parent_sample_id", "class")


CROPS = ", cr AS (SELECT *, CASE WHEN CAST(floor(CAST(source_id AS BIGINT) / 2) AS BIGINT) % 10 < 8 THEN 'train' ELSE 'val' END AS split FROM clips)"


@query("j18_crop_problems", "clips", CROPS + """, ex AS ((SELECT sample_id, split FROM cr EXCEPT SELECT sample_id, official_split FROM clips) UNION ALL (SELECT sample_id, official_split FROM clips EXCEPT SELECT sample_id, split FROM cr))
SELECT 'membership' AS code, sample_id AS key FROM ex UNION ALL SELECT 'split', sample_id FROM cr WHERE split IS DISTINCT FROM official_split
UNION ALL SELECT 'parent_sample_id', a.sample_id FROM cr a LEFT JOIN clips b ON a.parent_sample_id = b.sample_id WHERE a.parent_sample_id IS NOT NULL AND a.split IS DISTINCT FROM b.official_split
UNION ALL SELECT 'paired_sample_id', a.sample_id FROM cr a LEFT JOIN clips b ON a.paired_sample_id = b.sample_id WHERE a.paired_sample_id IS NOT NULL AND a.split IS DISTINCT FROM b.official_split""")
def _(get):
    clips = get("clips")
    own = F.when(F.floor(F.col("source_id").cast("bigint") / 2) % 10 < 8, "train").otherwise("val")
    official = clips.select("sample_id", F.col("official_split").alias("split"))
    return A.crop_problems(clips.withColumn("split", own), official, ("parent_sample_id", "paired_sample_id"))


@query("a4_slot_audit", "faces", f""", v AS (SELECT DISTINCT video_id, det_key2 % 2 AS m, frame_index AS f FROM faces), mem AS (SELECT DISTINCT video_id, m FROM v), n AS (SELECT video_id, count(*) AS members FROM mem GROUP BY 1),
h AS (SELECT v.video_id, m, slot, rank, t.f AS f FROM v JOIN {TRIES} ON t.f = v.f), j AS (SELECT h.video_id, slot, min(rank) AS rank, min_by(f, rank) AS f FROM (SELECT video_id, slot, rank, f, count(*) AS have FROM h GROUP BY ALL) h JOIN n ON n.video_id = h.video_id WHERE have = members GROUP BY ALL),
o AS (SELECT video_id, m, slot, min_by(f, rank) AS f FROM h GROUP BY ALL), e AS (SELECT mem.video_id, mem.m, s.slot, s.p, j.rank, coalesce(j.f, o.f) AS f FROM mem CROSS JOIN (VALUES {", ".join(f"({i}, {p})" for i, p in enumerate(PLANNED))}) s(slot, p) LEFT JOIN j ON j.video_id = mem.video_id AND j.slot = s.slot LEFT JOIN o ON o.video_id = mem.video_id AND o.m = mem.m AND o.slot = s.slot),
w AS (SELECT video_id, m, p, f, min(rank) OVER fam AS r, count(*) OVER fam - count(f) OVER fam AS without FROM e WINDOW fam AS (PARTITION BY video_id, slot)),
y AS (SELECT video_id, m, p, f, CASE WHEN f IS NULL THEN 'failed' WHEN f = p THEN 'planned' WHEN r > 0 THEN 'joint' WHEN without = 0 THEN 'individual' ELSE 'failed' END AS k FROM w)
SELECT video_id, m AS member, count(*) AS slots, count(*) FILTER (k = 'planned') AS planned_slots, count(*) FILTER (k IN ('joint', 'individual')) AS recovered_slots, count(*) FILTER (k = 'individual') AS individual_slots, count(*) FILTER (k = 'failed') AS failed_slots, round(avg(f - p) FILTER (k <> 'failed'), 8) AS mean_offset FROM y GROUP BY video_id, m""")
def _(get):
    valid = get("faces").withColumn("member", F.col("det_key2") % 2)
    return A.slot_audit(T.resolve_slots(valid, PLANNED, PLAN_COUNT), PLANNED)


#: Conditions of the robustness matrix: name, severity, and what becomes of a frame's logit.
CONDITIONS = (
    ("clean", "none", "logit"),
    ("dim", "mild", "logit - 0.05 * q1"),
    ("bright", "mild", "logit + 0.05 * q2"),
    ("grain", "moderate", "logit - 0.2 * q3 + 0.1 * q1"),
    ("smear", "severe", "logit * 0.2 + 0.3 * q2"),
)
MATRIX = (
    ", cv AS (" + " UNION ALL ".join(f"SELECT '{n}' AS condition, '{s}' AS severity, sample_id, max(y) AS y, round(avg({e}), 6) AS score FROM frames GROUP BY sample_id" for n, s, e in CONDITIONS) + "), sd AS (SELECT condition || '/' || severity AS grp, y, score FROM cv)" + AREAS
    + f", ma AS (SELECT split_part(grp, '/', 1) AS condition, split_part(grp, '/', 2) AS severity, {AREA.replace('round(', '(', 1).replace(', 8)', ')')} FROM ar)"
)


def matrix_of(get) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(s).alias("severity"), F.expr(e).alias("score")) for n, s, e in CONDITIONS])
    frames = get("frames").select("sample_id", "y", F.explode(cells).alias("cell")).select("sample_id", "y", "cell.*")
    videos = frames.groupBy("condition", "severity", "sample_id").agg(F.max("y").alias("y"), F.round(F.avg("score"), 6).alias("score"))
    return auroc(videos, "y", "score", ["condition", "severity"])


@query("a17_condition_deltas", "frames", MATRIX + " SELECT condition, severity, round(auroc, 8) AS auroc, round(auroc - (SELECT auroc FROM ma WHERE condition = 'clean'), 8) AS delta FROM ma WHERE condition <> 'clean'")
def _(get):
    return A.condition_deltas(matrix_of(get), "auroc")


@query("a17_severity_summary", "frames", MATRIX + ", de AS (SELECT * FROM ma WHERE condition <> 'clean' UNION ALL SELECT condition, 'all', auroc FROM ma WHERE condition <> 'clean') SELECT severity, round(avg(auroc), 8) AS mean, round(min(auroc), 8) AS worst, min_by(condition, struct_pack(a := auroc, c := condition)) AS worst_condition FROM de GROUP BY severity")
def _(get):
    return A.severity_summary(matrix_of(get), "auroc")
