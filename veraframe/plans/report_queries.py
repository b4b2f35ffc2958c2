"""Queries over whole reports: acquisition, provenance, augmentation plans, threshold sweeps and calibration fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veraframe.functions import provenance as P
from veraframe.functions.augmentation import augmentation_plan
from veraframe.functions.sampling import family_plans, nested_plans
from veraframe.operators import audits as A
from veraframe.operators import decisions as D
from veraframe.operators import manifests as M
from veraframe.operators import metrics
from veraframe.operators import sweeps as W
from veraframe.plans.media_queries import UNIT
from veraframe.plans.registry import registry
from veraframe.plans.score_queries import DECIDE_SQL, GATE_SQL, STAGES, decisions_of
from veraframe.sources.shared import materialise

QUERIES, ORACLES, query = registry()


@query("j15_acquisition_by_class", "listing", """, e AS (SELECT class, stem FROM listing), f AS (SELECT *, name LIKE '%.mp4' AS clip, name LIKE 'tmp%' AS part, CASE WHEN name LIKE '%.mp4' THEN regexp_replace(name, '\\.mp4$', '') END AS of FROM listing),
g AS (SELECT f.*, e.stem IS NOT NULL AS wanted FROM f LEFT JOIN e ON e.class = f.class AND e.stem = f.of), n AS (SELECT class, count(*) AS expected FROM e GROUP BY 1), m AS (SELECT e.class, count(*) AS missing FROM e LEFT JOIN f ON f.class = e.class AND f.of = e.stem WHERE f.of IS NULL GROUP BY 1)
SELECT g.class, max(expected) AS expected, count(*) FILTER (clip) AS found, CAST(coalesce(sum(bytes) FILTER (clip), 0) AS BIGINT) AS total_bytes, coalesce(max(missing), 0) AS missing, count(*) FILTER ((clip AND NOT wanted) OR (NOT clip AND NOT part)) AS unexpected, count(*) FILTER (clip AND bytes = 0) AS zero_byte,
  count(*) FILTER (part) AS partial_downloads, count(*) FILTER (clip AND bytes > 0 AND NOT readable) AS unreadable, min(duration_s) FILTER (clip AND bytes > 0 AND readable) AS duration_s_min, max(duration_s) FILTER (clip AND bytes > 0 AND readable) AS duration_s_max FROM g JOIN n ON n.class = g.class LEFT JOIN m ON m.class = g.class GROUP BY g.class""")
def _(get):
    files = get("listing")
    return A.acquisition_by_class(files.select("class", "stem"), files.drop("stem"))


@query("j15_probe_histograms", "listing", """, r AS (SELECT * FROM listing WHERE name LIKE '%.mp4' AND bytes > 0 AND readable)
SELECT class, 'resolution' AS measure, width || 'x' || height AS value, count(*) AS files FROM r GROUP BY ALL UNION ALL SELECT class, 'codec', codec, count(*) FROM r GROUP BY ALL""")
def _(get):
    return A.probe_histograms(get("listing"))


@query("f12_provenance_summary", "stores", """, b AS (SELECT *, store LIKE '%broken' AS bad FROM stores)
SELECT asset_id, CASE WHEN bad THEN NULL ELSE event_type END AS title, CASE WHEN bad THEN NULL ELSE 'Org ' || org END AS signer_organization, CASE WHEN bad OR timing = 3 THEN 'absent' WHEN timing = 1 THEN 'trusted' WHEN timing = 2 THEN 'untrusted' ELSE 'present' END AS timestamp,
  CASE WHEN bad THEN '' ELSE CASE WHEN asset_id % 2 = 0 THEN 'c2pa.created/Tool/' ELSE 'other//' END || CASE kind WHEN 0 THEN 'trainedAlgorithmicMedia' WHEN 1 THEN 'digitalCapture' ELSE 'other' END || ',c2pa.edited//' END AS actions,
  NOT bad AND kind = 0 AS declares_ai_generated, CASE WHEN bad THEN '' WHEN asset_id % 5 = 0 THEN 'part:parentOf:true' ELSE 'part:other:true' END AS ingredients, CASE WHEN bad THEN 0 ELSE 2 END AS manifest_count,
  CASE WHEN NOT bad AND timing = 2 THEN 'timeStamp.mismatch' ELSE '' END AS failure_codes FROM b""")
def _(get):
    s = P.provenance_summary(get("stores"), "store", ["asset_id"])
    blank = lambda c: F.coalesce(c, F.lit(""))
    acts = F.array_join(F.transform("actions", lambda a: F.concat_ws("/", a["action"], blank(a["software_agent"]), blank(a["digital_source_type"]["code"]))), ",")
    parts = F.array_join(F.transform("ingredients", lambda i: F.concat_ws(":", i["title"], i["relationship"], i["has_own_credentials"].cast("string"))), ",")
    return s.select("asset_id", "title", "signer_organization", "timestamp", acts.alias("actions"), "declares_ai_generated", parts.alias("ingredients"), "manifest_count", F.array_join("failure_codes", ",").alias("failure_codes"))


def unit(op: str, what: str) -> str:
    return UNIT.format(f"'7:' || epoch || ':{op}:{what}:' || media_id")


def strength(op: str, mild: float, moderate: float) -> str:
    return f"({mild} + ({moderate} - {mild}) * {unit(op, 'severity')} * cap)"


@query("f15_severity_plan", "media", f""", e AS (SELECT media_id, CAST(media_id % 7 - 1 AS INT) AS epoch FROM media), c AS (SELECT *, CASE WHEN epoch < 0 THEN 0.0 ELSE least(1.0, 0.5 + 0.5 * epoch / 4) END AS cap FROM e), d AS (SELECT media_id, epoch, CAST(cap AS DOUBLE) AS cap FROM c)
SELECT media_id, epoch, round(cap, 8) AS severity_cap, CASE WHEN epoch >= 0 AND {unit("gamma", "gate")} < 0.3 THEN round(exp(CASE WHEN {unit("gamma", "sign")} < 0.5 THEN 1 ELSE -1 END * {strength("gamma", 0.05, 0.22)}), 8) END AS gamma,
  CASE WHEN epoch >= 0 AND {unit("resize", "gate")} < 0.3 THEN round({strength("resize", 0.9, 0.45)}, 8) END AS resize, CASE WHEN epoch >= 0 AND {unit("blur", "gate")} < 0.2 THEN round({strength("blur", 0.3, 1.5)}, 8) END AS blur,
  CASE WHEN epoch >= 0 AND {unit("noise", "gate")} < 0.2 THEN round({strength("noise", 1.0, 8.0)}, 8) END AS noise, CASE WHEN epoch >= 0 AND {unit("codec", "gate")} < 0.35 THEN CAST(round_even({strength("jpeg", 90.0, 40.0)}, 0) AS INT) END AS jpeg,
  CASE WHEN epoch >= 0 AND {unit("codec", "gate")} >= 0.35 AND {unit("codec", "gate")} < 0.65 THEN round({strength("h264_qp", 22.0, 36.0)}, 8) END AS h264_qp FROM d""")
def _(get):
    rows = get("media").select("media_id", (F.col("media_id") % 7 - 1).cast("int").alias("epoch"))
    return augmentation_plan(rows, "media_id", "epoch", 7)


TAILS, BUDGET = (1.0, 2.0, 5.0, 10.0, 20.0), 0.22
GATED_TAIL = GATE_SQL.removeprefix(DECIDE_SQL).lstrip(", ")


def tail_sql(i: int, tail: float) -> str:
    """The decided rate behind the gate of one tail, whose thresholds are in ``th``."""
    gate = GATED_TAIL.replace("q1 < 1.0", f"q1 < (SELECT s FROM th WHERE i = {i})").replace("q2 < 1.0", f"q2 < (SELECT h FROM th WHERE i = {i})").replace("q3 > 3.0", f"q3 > (SELECT b FROM th WHERE i = {i})")
    return f"SELECT {i} AS i, rate FROM (WITH {gate} SELECT avg((verdict <> 'uncertain')::INT) AS rate FROM final) z{i}"


@query("m21_gate_sweep", "frames", DECIDE_SQL + ", th AS (" + " UNION ALL ".join(f"SELECT {i} AS i, CAST({t} AS DOUBLE) AS pct, quantile_cont(q1, {t / 100}) AS s, quantile_cont(q2, {t / 100}) AS h, quantile_cont(q3, {1 - t / 100}) AS b FROM frames" for i, t in enumerate(TAILS)) + "), ra AS (" + " UNION ALL ".join(tail_sql(i, t) for i, t in enumerate(TAILS)) + f"""),
sw AS (SELECT th.*, rate, (SELECT avg((verdict <> 'uncertain')::INT) FROM decisions) AS base FROM th JOIN ra USING (i)) SELECT pct AS percentile, round(s, 8) AS sharpness_min, round(h, 8) AS hf_ratio_min, round(b, 8) AS blockiness_max, round(base, 8) AS base_rate, round(rate, 8) AS decided_rate, round(base - rate, 8) AS coverage_loss,
  base - rate <= {BUDGET} AS passes, coalesce(i = (SELECT max(i) FROM sw WHERE base - rate <= {BUDGET}), false) AS chosen FROM sw""")
def _(get):
    frames = get("frames")
    gates = W.gate_thresholds(frames, ["q1", "q2", "q3"], TAILS)
    return W.threshold_sweep(frames, decisions_of(get), STAGES, gates, ["q1", "q2", "q3"], BUDGET)


def calibration_parts(get):
    scores = D.stage_scores(get("frames"), [4, 16], keep=["y"])
    parts = M.exact_partition(scores.select("sample_id"), "sample_id", (0.4, 0.3, 0.3), ("dev", "temperature", "conformal"), 42)
    return materialise(scores.join(parts, "sample_id"), "calibration")


@query("m17_calibration_fits")
def _(get):
    return W.calibration_fits(calibration_parts(get), ["score_4", "score_16"], "y", "sample_id", "partition", [0.01, 0.05, 0.1])


@query("m17_calibration_losses")
def _(get):
    return W.calibration_losses(calibration_parts(get), ["score_4", "score_16"], "y", "sample_id", "partition")


PLAN_SQL = """, m AS (SELECT {key} AS key, {n} AS n, least(16, {n}) AS m FROM {table}), i AS (SELECT key, n, m, unnest(range(m)) AS i FROM m), p AS (SELECT DISTINCT key, CASE WHEN m = 1 THEN 0 ELSE CAST(round_even(i * (n - 1) / (m - 1), 0) AS BIGINT) END AS f FROM i), k AS (SELECT key, f, row_number() OVER (PARTITION BY key ORDER BY f) - 1 AS pos FROM p)"""


def shown(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


@query("d9_nested_plans", "media", PLAN_SQL.format(key="media_id", n="frame_count", table="media") + """ SELECT key AS media_id, string_agg(CAST(f AS VARCHAR), ',' ORDER BY f) AS plan_16, string_agg(CAST(f AS VARCHAR), ',' ORDER BY f) FILTER (pos % 2 = 0) AS plan_8, string_agg(CAST(f AS VARCHAR), ',' ORDER BY f) FILTER (pos % 4 = 0) AS plan_4 FROM k GROUP BY key""")
def _(get):
    return nested_plans(get("media"), "frame_count").select("media_id", shown("plan_16"), shown("plan_8"), shown("plan_4"))


@query("d9_family_plans", "media", ", fa AS (SELECT media_id // 4 AS family, count(*) AS members, CAST(min(frame_count // 4) AS INT) AS shared FROM media GROUP BY 1), ok AS (SELECT family, shared FROM fa WHERE shared >= 16)" + PLAN_SQL.format(key="family", n="shared", table="ok") + """, t AS (SELECT key, string_agg(CAST(f AS VARCHAR), ',' ORDER BY f) AS plan FROM k GROUP BY key)
SELECT family, members, shared, plan FROM fa LEFT JOIN t ON t.key = fa.family""")
def _(get):
    rows = get("media").select(F.expr("media_id div 4").alias("family"), F.expr("cast(frame_count div 4 as int)").alias("frames"))
    return family_plans(rows, "family", "frames").select("family", "members", "shared", shown("plan"))


HYBRID = D.Gate(1.0, 1.0, 3.0, noise_max=0.5)


@query("p9_hybrid_flags", "frames", "SELECT sample_id, slot, q1 < 1.0 AS low_sharpness, q2 < 1.0 AS low_resolution, q3 > 3.0 AS high_compression, logit > 0.5 AS high_noise FROM frames")
def _(get):
    flags = HYBRID.flags(*[F.col(c) for c in ("q1", "q2", "q3", "logit")])
    return get("frames").select("sample_id", "slot", *[f.alias(c.lower()) for c, f in flags.items()])


SECOND = DECIDE_SQL.lstrip(", ").replace("FROM frames ", "FROM second ")


@query("a22_decision_agreement", "frames", DECIDE_SQL + f""", second AS (SELECT * REPLACE (logit + 0.1 * (slot - 8) AS logit) FROM frames), o AS (SELECT sample_id, verdict, frames_used FROM (WITH {SECOND} SELECT * FROM decisions) z),
j AS (SELECT d.y, d.verdict AS va, o.verdict AS vb, d.frames_used AS ka, o.frames_used AS kb FROM decisions d JOIN o USING (sample_id))
SELECT count(*) AS n, 0 AS unmatched, round(avg((va = vb)::INT), 8) AS verdict_agreement, round(avg((ka = kb)::INT), 8) AS frames_agreement, count(*) FILTER (y = 0 AND va = 'likely_manipulated') AS false_accusations_a, count(*) FILTER (y = 0 AND vb = 'likely_manipulated') AS false_accusations_b,
  count(*) FILTER (y = 0 AND vb = 'likely_manipulated' AND va <> 'likely_manipulated') AS new_false_accusations FROM j""")
def _(get):
    other = get("frames").withColumn("logit", F.col("logit") + 0.1 * (F.col("slot") - 8))
    second = D.adaptive(D.stage_scores(other, [4, 8, 16], keep=["y", "method"]), STAGES)
    return D.decision_agreement(decisions_of(get), second)


@query("m26_agreement_summary", "thumbs", """, p AS (SELECT a.vec_id, unnest(range(64)) AS i, unnest(a.embedding) AS x, unnest(b.embedding) AS y FROM thumbs a JOIN thumbs b ON b.vec_id = a.vec_id + 1), r AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY x, i) AS rx, row_number() OVER (PARTITION BY vec_id ORDER BY y, i) AS ry FROM p),
c AS (SELECT vec_id, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1) SELECT count(*) AS n, round(avg((rho >= 0.1)::INT), 8) AS pass_rate, round(quantile_cont(rho, 0.1), 8) AS p10, round(quantile_cont(rho, 0.5), 8) AS median FROM c""")
def _(get):
    t = get("thumbs").select("vec_id", "embedding")
    both = t.join(t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    items = both.select("vec_id", F.explode(F.arrays_zip("embedding", "other", F.sequence(F.lit(0), F.lit(63)).alias("i"))).alias("z")).select("vec_id", "z.*")
    rank = lambda c: F.row_number().over(Window.partitionBy("vec_id").orderBy(c, "i"))
    rho = items.withColumns({"rx": rank("embedding"), "ry": rank("other")}).groupBy("vec_id").agg(F.round(F.corr("rx", "ry"), 6).alias("rho"))
    return metrics.agreement_summary(rho, "rho", 0.1)
