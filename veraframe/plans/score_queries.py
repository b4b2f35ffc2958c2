"""Queries over score tables, frames and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veraframe.functions import scalars as S
from veraframe.operators import decisions as D
from veraframe.operators import metrics as M
from veraframe.operators.manifests import aligned_margins, only_splits
from veraframe.operators.ordering import percentiles
from veraframe.plans.registry import registry

QUERIES, ORACLES, query = registry()

STAGES = [D.Stage(4, 0.015, 0.8, 0.62, 0.55), D.Stage(8, 0.015, 0.7, 0.6, 0.5), D.Stage(16, 0.02, 0.6, 0.55, 0.45)]
GATE = D.Gate(1.0, 1.0, 3.0, majority=0.5)


P = "1 / (1 + exp(-greatest(-60.0, least(60.0, logit))))"


def with_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", S.sigmoid("logit"))


@query("f1_sigmoid", "scored", f"SELECT row_key, round({P}, 8) AS p, round(1 / (1 + exp(-greatest(-60.0, least(60.0, 100 * logit)))), 8) AS steep FROM scored")
def _(get):
    return get("scored").select("row_key", S.sigmoid("logit").alias("p"), S.sigmoid(F.col("logit") * 100).alias("steep"))


@query("w1_average_rank", "scored", "SELECT row_key, rank() OVER (ORDER BY logit) + (count(*) OVER (PARTITION BY logit) - 1) / 2.0 AS rank FROM scored")
def _(get):
    df = get("scored")
    return df.join(M.average_ranks(df, "logit").select("logit", "rank"), "logit").select("row_key", "rank")


AUC = """SELECT {by} round(sum(CASE WHEN y = 1 THEN r END - (np + 1) / 2.0) / NULLIF(max(np) * max(nn), 0), 8) AS auroc, max(np) AS n_pos, max(nn) AS n_neg FROM (
  SELECT *, rank() OVER ({part} ORDER BY logit) + (count(*) OVER (PARTITION BY {parts} logit) - 1) / 2.0 AS r,
         CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) OVER ({part}) AS BIGINT) AS np, CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) OVER ({part}) AS BIGINT) AS nn FROM scored) t {group}"""


@query("m1_auroc", "scored", AUC.format(by="", part="", parts="", group=""))
def _(get):
    return M.auroc(get("scored"), "y", "logit")


@query("m1_auroc_by_method", "scored", AUC.format(by="method,", part="PARTITION BY method", parts="method,", group="GROUP BY method"))
def _(get):
    return M.auroc(get("scored"), "y", "logit", ["method"])


@query("m2_average_precision", "scored", """SELECT round(avg(CASE WHEN y = 1 THEN hits / seen END), 8) AS ap FROM (
  SELECT y, sum(y) OVER (ORDER BY logit DESC, row_key ROWS UNBOUNDED PRECEDING) AS hits, row_number() OVER (ORDER BY logit DESC, row_key) AS seen FROM scored) t""")
def _(get):
    return M.average_precision(get("scored"), "y", "logit", "row_key")


CONFUSION = """, c AS (SELECT count(*) FILTER (y = 1 AND logit >= 0) AS tp, count(*) FILTER (y = 0 AND logit >= 0) AS fp, count(*) FILTER (y = 0 AND logit < 0) AS tn, count(*) FILTER (y = 1 AND logit < 0) AS fn FROM scored),
r AS (SELECT *, coalesce(tp / NULLIF(tp + fn, 0), 0) AS se, coalesce(tn / NULLIF(tn + fp, 0), 0) AS sp FROM c)
SELECT tp, fp, tn, fn, round(se, 8) AS sensitivity, round(sp, 8) AS specificity, round(coalesce(tp / NULLIF(tp + fp, 0), 0), 8) AS precision,
       round((tp + tn) / (tp + fp + tn + fn), 8) AS accuracy, round((se + sp) / 2, 8) AS balanced_accuracy, round(coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0), 8) AS f1 FROM r"""


@query("m3_confusion", "scored", CONFUSION)
def _(get):
    return M.confusion(get("scored"), "y", F.col("logit") >= 0)


@query("m4_spearman", "scored", """, r AS (SELECT rank() OVER (ORDER BY logit) + (count(*) OVER (PARTITION BY logit) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM scored)
SELECT count(*) AS n, round(corr(a, b), 8) AS rho FROM r""")
def _(get):
    return M.spearman(get("scored"), "logit", "y")


@query("m5_mean_ci", "scored", """SELECT method, count(*) AS n, round(avg(logit), 8) AS mean, round(avg(logit) - 1.96 * stddev_samp(logit) / sqrt(count(*)), 8) AS low,
  round(avg(logit) + 1.96 * stddev_samp(logit) / sqrt(count(*)), 8) AS high FROM scored GROUP BY method""")
def _(get):
    return M.mean_ci(get("scored"), "logit", ["method"])


BIN = " + ".join(f"CASE WHEN p > {i}/15.0 THEN 1 ELSE 0 END" for i in range(1, 15))


@query("m6_ece", "scored", f", q AS (SELECT y, {P} AS p FROM scored), b AS (SELECT {BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM q GROUP BY 1) SELECT round(sum(n * abs(mp - my)) / sum(n), 8) AS ece FROM b")
def _(get):
    return M.expected_calibration_error(get("scored"), "y", S.sigmoid("logit"))


@query("m6_calibration_bins", "scored", f", q AS (SELECT y, {P} AS p FROM scored) SELECT CAST({BIN} AS INT) AS bin, count(*) AS n, round(avg(p), 8) AS mean_p, round(avg(y), 8) AS mean_y FROM q GROUP BY 1")
def _(get):
    return M.calibration_bins(get("scored"), "y", S.sigmoid("logit"))


@query("m7_point_losses", "scored", f"""SELECT round(avg(-CASE WHEN y = 1 THEN ln(p + 1e-12) ELSE ln(1 - p + 1e-12) END), 8) AS nll, round(avg((p - y) * (p - y)), 8) AS brier,
  round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM (SELECT y, {P} AS p FROM scored) t""")
def _(get):
    return M.point_losses(get("scored"), "y", S.sigmoid("logit"))


@query("m10_temperature_fit")
def _(get):
    df = get("scored")
    return df.sparkSession.range(1).select(F.lit(M.fit_temperature(df, "y", "logit")).alias("temperature")).withColumn("log_t", F.log("temperature"))


QUANTILE = f""", s AS (SELECT y, CASE WHEN y = 1 THEN 1 - p ELSE p END AS s FROM (SELECT y, {P} AS p FROM scored) t),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY s) AS k, count(*) OVER (PARTITION BY y) AS n, row_number() OVER (ORDER BY s) AS ka, count(*) OVER () AS na FROM s),
a AS (SELECT unnest([0.05, 0.1, 0.2]) AS alpha, unnest([0.95, 0.9, 0.8]) AS keep)"""


@query("m12_conformal_mondrian", "scored", QUANTILE + """SELECT CAST(alpha AS DOUBLE) AS alpha, round(coalesce(min(CASE WHEN y = 0 AND k >= ceil((n + 1) * CAST(keep AS DOUBLE)) THEN s END), 1.0), 8) AS q_real,
  round(coalesce(min(CASE WHEN y = 1 AND k >= ceil((n + 1) * CAST(keep AS DOUBLE)) THEN s END), 1.0), 8) AS q_fake, count(*) FILTER (y = 0) AS n_real, count(*) FILTER (y = 1) AS n_fake FROM r, a GROUP BY alpha""")
def _(get):
    return M.conformal_fit(with_p(get("scored")), "y", "p", [0.05, 0.1, 0.2], mondrian=True)


@query("m12_conformal_marginal", "scored", QUANTILE + """SELECT CAST(alpha AS DOUBLE) AS alpha, round(coalesce(min(CASE WHEN ka >= ceil((na + 1) * CAST(keep AS DOUBLE)) THEN s END), 1.0), 8) AS q_real,
  round(coalesce(min(CASE WHEN ka >= ceil((na + 1) * CAST(keep AS DOUBLE)) THEN s END), 1.0), 8) AS q_fake, count(*) FILTER (y = 0) AS n_real, count(*) FILTER (y = 1) AS n_fake FROM r, a GROUP BY alpha""")
def _(get):
    return M.conformal_fit(with_p(get("scored")), "y", "p", [0.05, 0.1, 0.2], mondrian=False)


@query("m11_conformal_quantile", "scored", f""", s AS (SELECT method, {P} AS s FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY s) AS k, count(*) OVER (PARTITION BY method) AS n FROM s)
SELECT method, n, round(coalesce(min(CASE WHEN k >= ceil((n + 1) * CAST(0.9 AS DOUBLE)) THEN s END), 1.0), 8) AS q FROM r GROUP BY method, n""")
def _(get):
    return M.conformal_quantile(with_p(get("scored")), "p", 0.1, ["method"])


SETS = f"SELECT row_key, y, p, p <= 0.62 AS in_real, 1 - p <= 0.45 AS in_fake FROM (SELECT *, {P} AS p FROM scored) t"
VERDICT = "CASE WHEN in_real AND NOT in_fake THEN 'likely_real' WHEN in_fake AND NOT in_real THEN 'likely_manipulated' ELSE 'uncertain' END"


@query("m13_prediction_sets", "scored", f"SELECT row_key, in_real, in_fake, {VERDICT} AS verdict FROM ({SETS}) s")
def _(get):
    return M.prediction_sets(with_p(get("scored")), "p", F.lit(0.62), F.lit(0.45)).select("row_key", "in_real", "in_fake", "verdict")


@query("m14_conformal_evaluation", "scored", f""", s AS (SELECT *, {VERDICT} AS verdict, CASE WHEN y = 1 THEN in_fake ELSE in_real END AS cov FROM ({SETS}) t)
SELECT round(avg(cov::INT), 8) AS coverage, round(avg(cov::INT) FILTER (y = 0), 8) AS coverage_real, round(avg(cov::INT) FILTER (y = 1), 8) AS coverage_fake, round(avg((verdict = 'uncertain')::INT), 8) AS abstention,
  round(avg((NOT in_real AND NOT in_fake)::INT), 8) AS empty_rate, round(avg(((verdict = 'likely_manipulated') = (y = 1))::INT) FILTER (verdict <> 'uncertain'), 8) AS selective_accuracy FROM s""")
def _(get):
    return M.conformal_evaluation(M.prediction_sets(with_p(get("scored")), "p", F.lit(0.62), F.lit(0.45)), "y")


RISK = f""", q AS (SELECT row_key, y, {P} AS p FROM scored), e AS (SELECT count(*) OVER () AS n, row_number() OVER (ORDER BY greatest(p, 1 - p) DESC, row_key) AS k,
  CAST(sum(((p >= 0.5) <> (y = 1))::INT) OVER (ORDER BY greatest(p, 1 - p) DESC, row_key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS err FROM q)"""


@query("m15_risk_coverage", "scored", RISK + """, c AS (SELECT CAST(step AS INT) AS step, greatest(1, CAST(round_even((1 / 21 + step * ((1 - 1 / 21) / 20)) * (SELECT count(*) FROM scored), 0) AS BIGINT)) AS pos FROM range(21) r(step))
SELECT step, round(k / n, 8) AS coverage, round(err / k, 8) AS risk FROM c JOIN e ON k = pos""")
def _(get):
    return M.risk_coverage(with_p(get("scored")), "y", "p", "row_key")


@query("m15_aurc", "scored", RISK + "SELECT round(avg(err / k), 8) AS aurc FROM e")
def _(get):
    return M.aurc(with_p(get("scored")), "y", "p", "row_key")


@query("m16_confidence_abstention", "scored", RISK + "SELECT round(1 - k / n, 8) AS abstention, round((k - err) / k, 8) AS selective_accuracy FROM e WHERE k = greatest(1, CAST(round_even(0.8 * n, 0) AS BIGINT))")
def _(get):
    return M.confidence_abstention(with_p(get("scored")), "y", "p", "row_key", 0.2)


@query("m20_threshold_fit", "scored", "SELECT round(quantile_cont(logit, 0.05), 8) AS p05, round(quantile_cont(logit, 0.5), 8) AS p50, round(quantile_cont(logit, 0.95), 8) AS p95 FROM scored")
def _(get):
    return percentiles(get("scored"), "logit", {f"p{int(q * 100):02d}": q for q in (0.05, 0.5, 0.95)}).drop("n")


@query("m9_operating_points", "frames", """, v AS (SELECT sample_id, y, avg(logit) AS z FROM frames GROUP BY ALL), c AS (SELECT quantile_cont(z, 1 - CAST(0.9 AS DOUBLE)) AS cut FROM v WHERE y = 1)
SELECT round(max(cut), 8) AS cut, round(avg((z >= 0)::INT) FILTER (y = 1), 8) AS tpr, round(avg((z >= 0)::INT) FILTER (y = 0), 8) AS fpr, round(avg((z >= cut)::INT) FILTER (y = 0), 8) AS fpr_at_tpr FROM v, c""")
def _(get):
    return M.operating_points(get("frames").groupBy("sample_id", "y").agg(F.avg("logit").alias("z")), "y", "z")


@query("a8_video_scores", "frames", "SELECT sample_id, y, method, round(avg(logit), 8) AS score FROM frames GROUP BY ALL")
def _(get):
    return get("frames").groupBy("sample_id", "y", "method").agg(F.avg("logit").alias("score"))


STAGE_SQL = """, s AS (SELECT sample_id, y, method, count(*) AS n_frames,
  CASE WHEN count(*) FILTER (slot % 4 = 0) = 4 THEN avg(logit) FILTER (slot % 4 = 0) END AS score_4, CASE WHEN count(*) FILTER (slot % 2 = 0) = 8 THEN avg(logit) FILTER (slot % 2 = 0) END AS score_8,
  CASE WHEN count(*) = 16 THEN avg(logit) END AS score_16 FROM frames GROUP BY ALL)"""


@query("a9_stage_scores", "frames", STAGE_SQL + "SELECT sample_id, y, method, n_frames, round(score_4, 8) AS score_4, round(score_8, 8) AS score_8, round(score_16, 8) AS score_16 FROM s")
def _(get):
    return D.stage_scores(get("frames"), [4, 8, 16], keep=["y", "method"])


SIG = "1 / (1 + exp(-greatest(-60.0, least(60.0, {})))) "
DECIDE_SQL = STAGE_SQL + "".join(f", p{s.k} AS (SELECT *, {SIG.format(f'score_{s.k} / {s.temperature}')} AS p_{s.k} FROM {prev}), t{s.k} AS (SELECT *, p_{s.k} <= {s.q_real} AS real_{s.k}, 1 - p_{s.k} <= {s.q_fake} AS fake_{s.k} FROM p{s.k})" for s, prev in zip(STAGES, ["s", "t4", "t8"], strict=True)) + """
, r AS (SELECT *, CASE WHEN score_4 IS NULL THEN 'insufficient_frames_for_k4' WHEN real_4 <> fake_4 THEN 'confident_singleton_k4' WHEN score_8 IS NULL THEN 'insufficient_frames_for_k8' WHEN real_8 <> fake_8 THEN 'confident_singleton_k8'
   WHEN score_16 IS NULL THEN 'insufficient_frames_for_k16' WHEN real_16 <> fake_16 THEN 'final_k16_singleton' WHEN real_16 THEN 'final_k16_uncertain_both' ELSE 'final_k16_uncertain_empty' END AS reason FROM t16),
u AS (SELECT *, CASE WHEN reason = 'insufficient_frames_for_k4' THEN 0 WHEN reason IN ('confident_singleton_k4', 'insufficient_frames_for_k8') THEN 4 WHEN reason IN ('confident_singleton_k8', 'insufficient_frames_for_k16') THEN 8 ELSE 16 END AS frames_used FROM r),
d AS (SELECT *, CASE frames_used WHEN 4 THEN p_4 WHEN 8 THEN p_8 WHEN 16 THEN p_16 END AS p_fake, CASE frames_used WHEN 4 THEN real_4 WHEN 8 THEN real_8 WHEN 16 THEN real_16 END AS in_real, CASE frames_used WHEN 4 THEN fake_4 WHEN 8 THEN fake_8 WHEN 16 THEN fake_16 END AS in_fake FROM u),
decisions AS (SELECT *, CASE WHEN reason LIKE 'insufficient%' OR in_real = in_fake THEN 'uncertain' WHEN in_real THEN 'likely_real' ELSE 'likely_manipulated' END AS verdict FROM d)"""


def decisions_of(get) -> DataFrame:
    return D.adaptive(D.stage_scores(get("frames"), [4, 8, 16], keep=["y", "method"]), STAGES)


@query("d1_adaptive_decision", "frames", DECIDE_SQL + "SELECT sample_id, verdict, reason, frames_used, round(p_fake, 8) AS p_fake, round(coalesce(greatest(p_fake, 1 - p_fake), 0), 8) AS confidence FROM decisions")
def _(get):
    return decisions_of(get).select("sample_id", "verdict", "reason", "frames_used", "p_fake", "confidence")


@query("d2_fixed_decision", "frames", DECIDE_SQL + f"""SELECT sample_id, round(p_8, 8) AS p_fake, CASE WHEN real_8 AND NOT fake_8 THEN 'likely_real' WHEN fake_8 AND NOT real_8 THEN 'likely_manipulated' ELSE 'uncertain' END AS verdict,
  CASE WHEN y = 1 THEN fake_8 ELSE real_8 END AS covered FROM decisions WHERE score_8 IS NOT NULL""")
def _(get):
    covered = F.when(F.col("y") == 1, F.col("in_fake")).otherwise(F.col("in_real"))
    return D.fixed(D.stage_scores(get("frames"), [8], keep=["y"]), STAGES[1]).select("sample_id", "p_fake", "verdict", covered.alias("covered"))


GATE_SQL = DECIDE_SQL + f""", used AS (SELECT f.*, q1 < 1.0 AS low_sharpness, q2 < 1.0 AS low_resolution, q3 > 3.0 AS high_compression FROM frames f JOIN decisions d USING (sample_id) WHERE d.frames_used > 0 AND f.slot % (16 // greatest(d.frames_used, 1)) = 0),
facts AS (SELECT sample_id, avg(low_sharpness::INT) AS f1, avg(low_resolution::INT) AS f2, avg(high_compression::INT) AS f3, count(*) FILTER (NOT (low_sharpness OR low_resolution OR high_compression)) AS passing,
  count(*) FILTER (low_sharpness OR low_resolution OR high_compression) AS bad, avg(logit) FILTER (NOT (low_sharpness OR low_resolution OR high_compression)) AS good FROM used GROUP BY sample_id),
g AS (SELECT d.sample_id, d.y, d.method, d.verdict AS base_verdict, d.frames_used, f1, f2, f3, passing, bad, list_filter([CASE WHEN f1 >= 0.5 THEN 'LOW_SHARPNESS' END, CASE WHEN f2 >= 0.5 THEN 'LOW_RESOLUTION' END, CASE WHEN f3 >= 0.5 THEN 'HIGH_COMPRESSION' END], lambda x: x IS NOT NULL) AS maj,
  CASE d.frames_used WHEN 4 THEN {SIG.format('good / 0.8')} WHEN 8 THEN {SIG.format('good / 0.7')} WHEN 16 THEN {SIG.format('good / 0.6')} END AS pg FROM decisions d LEFT JOIN facts USING (sample_id)),
h AS (SELECT *, CASE frames_used WHEN 4 THEN pg <= 0.62 WHEN 8 THEN pg <= 0.6 WHEN 16 THEN pg <= 0.55 END AS r2, CASE frames_used WHEN 4 THEN 1 - pg <= 0.55 WHEN 8 THEN 1 - pg <= 0.5 WHEN 16 THEN 1 - pg <= 0.45 END AS k2 FROM g),
i AS (SELECT *, base_verdict <> 'uncertain' AND len(maj) = 0 AND bad > 0 AND NOT coalesce(CASE WHEN r2 AND NOT k2 THEN 'likely_real' WHEN k2 AND NOT r2 THEN 'likely_manipulated' ELSE 'uncertain' END = base_verdict AND pg IS NOT NULL, false) AS dep FROM h),
gated AS (SELECT *, CASE WHEN dep THEN list_filter(['QUALITY_DEPENDENT', CASE WHEN f1 > 0 THEN 'LOW_SHARPNESS' END, CASE WHEN f2 > 0 THEN 'LOW_RESOLUTION' END, CASE WHEN f3 > 0 THEN 'HIGH_COMPRESSION' END], lambda x: x IS NOT NULL) ELSE coalesce(maj, []) END AS reasons FROM i),
final AS (SELECT *, base_verdict <> 'uncertain' AND len(reasons) > 0 AS is_gated, CASE WHEN base_verdict <> 'uncertain' AND len(reasons) > 0 THEN 'uncertain' ELSE base_verdict END AS verdict FROM gated)"""


def gated_of(get) -> DataFrame:
    return D.gated(get("frames"), decisions_of(get), STAGES, GATE, ["q1", "q2", "q3"])


@query("d3_quality_gate", "frames", GATE_SQL + "SELECT sample_id, base_verdict, verdict, is_gated AS gated, array_to_string(reasons, ',') AS reasons, coalesce(passing, 0) AS passing_frames FROM final")
def _(get):
    return gated_of(get).select("sample_id", "base_verdict", "verdict", "gated", F.array_join("reasons", ",").alias("reasons"), F.coalesce("passing_frames", F.lit(0)).alias("passing_frames"))


@query("d4_image_decision", "scored", f"""SELECT row_key, CASE WHEN logit < -0.5 THEN 'uncertain' ELSE {VERDICT} END AS verdict, {VERDICT} AS base_verdict, round(greatest(p, 1 - p), 6) AS confidence,
  CASE WHEN logit < -0.5 THEN 'LOW_SHARPNESS' ELSE '' END AS reason FROM (SELECT *, p <= 0.62 AS in_real, 1 - p <= 0.45 AS in_fake FROM (SELECT *, {P} AS p FROM scored) t) s""")
def _(get):
    sets = M.prediction_sets(with_p(get("scored")), "p", F.lit(0.62), F.lit(0.45))
    low = F.col("logit") < -0.5
    return sets.select("row_key", F.when(low, D.UNCERTAIN).otherwise(F.col("verdict")).alias("verdict"), F.col("verdict").alias("base_verdict"), F.round(F.greatest(F.col("p"), 1 - F.col("p")), 6).alias("confidence"), F.when(low, "LOW_SHARPNESS").otherwise("").alias("reason"))


SUMMARY = """count(*) AS n, count(*) FILTER (verdict <> 'uncertain') AS decided, round(avg((verdict = 'uncertain')::INT), 8) AS abstention, round(avg(((verdict = 'likely_manipulated') = (y = 1))::INT) FILTER (verdict <> 'uncertain'), 8) AS decided_accuracy,
  round(avg((verdict = 'likely_manipulated')::INT) FILTER (y = 0), 8) AS false_positive_rate, round(avg((verdict = 'likely_manipulated')::INT) FILTER (y = 1), 8) AS detection_rate, round(avg((verdict = 'likely_real')::INT) FILTER (y = 1), 8) AS miss_rate, round(avg(frames_used), 8) AS avg_frames"""


@query("a13_verdict_summary", "frames", DECIDE_SQL + f"SELECT {SUMMARY} FROM decisions")
def _(get):
    return D.verdict_summary(decisions_of(get))


@query("a13_verdict_summary_by_method", "frames", DECIDE_SQL + f"SELECT method, {SUMMARY} FROM decisions GROUP BY method")
def _(get):
    return D.verdict_summary(decisions_of(get), by=["method"])


@query("a14_stop_reasons", "frames", DECIDE_SQL + "SELECT reason, count(*) AS n FROM decisions GROUP BY reason")
def _(get):
    return decisions_of(get).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("a14_gate_reasons", "frames", GATE_SQL + "SELECT code, count(*) AS n FROM (SELECT unnest(reasons) AS code FROM final) t GROUP BY code")
def _(get):
    return gated_of(get).select(F.explode("reasons").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("m25_gate_matrix", "frames", GATE_SQL + f", m AS (SELECT 'gated' AS gate, method, verdict, y, frames_used FROM final UNION ALL SELECT 'none', method, base_verdict, y, frames_used FROM final) SELECT gate, method, {SUMMARY} FROM m GROUP BY gate, method")
def _(get):
    both = gated_of(get).join(decisions_of(get).select("sample_id", "y", "method"), "sample_id")
    long = both.select("method", "y", "frames_used", F.explode(F.array(F.struct(F.lit("gated").alias("gate"), "verdict"), F.struct(F.lit("none").alias("gate"), F.col("base_verdict").alias("verdict")))).alias("g")).select("method", "y", "frames_used", "g.gate", "g.verdict")
    return D.verdict_summary(long, by=["gate", "method"])


@query("a17_robustness_summary", "frames", GATE_SQL + """, m AS (SELECT method, avg(((verdict = 'likely_manipulated') = (y = 1))::INT) AS acc FROM final GROUP BY method)
SELECT min_by(method, struct_pack(a := acc, m := method)) AS worst, round(min(acc), 8) AS worst_accuracy, round(avg(acc), 8) AS mean_accuracy, round(min(acc) - max(acc) FILTER (method = 'original'), 8) AS worst_delta FROM m""")
def _(get):
    both = gated_of(get).join(decisions_of(get).select("sample_id", "y", "method"), "sample_id")
    right = ((F.col("verdict") == D.FAKE) == (F.col("y") == 1)).cast("double")
    return both.groupBy("method").agg(F.avg(right).alias("acc")).agg(
        F.min(F.struct("acc", "method")).getField("method").alias("worst"), F.min("acc").alias("worst_accuracy"), F.avg("acc").alias("mean_accuracy"),
        (F.min("acc") - F.max(F.when(F.col("method") == "original", F.col("acc")))).alias("worst_delta"),
    )


@query("d6_result_assembly", "frames", DECIDE_SQL + """, t AS (SELECT f.sample_id, string_agg(CAST(f.slot AS VARCHAR) || ':' || CAST(CASE WHEN f.slot % 4 = 0 THEN 4 WHEN f.slot % 2 = 0 THEN 8 ELSE 16 END AS VARCHAR), ',' ORDER BY f.slot) AS timeline
  FROM frames f JOIN decisions d USING (sample_id) WHERE d.frames_used > 0 AND f.slot % (16 // greatest(d.frames_used, 1)) = 0 GROUP BY f.sample_id)
SELECT d.sample_id, verdict, round(p_fake, 6) AS p_fake, round(coalesce(greatest(p_fake, 1 - p_fake), 0), 6) AS confidence, coalesce(timeline, '') AS timeline FROM decisions d LEFT JOIN t USING (sample_id)""")
def _(get):
    d = decisions_of(get).select("sample_id", "verdict", "p_fake", "confidence", "frames_used")
    used = get("frames").join(d.select("sample_id", "frames_used"), "sample_id").filter((F.col("frames_used") > 0) & (F.col("slot") % F.expr("16 div greatest(frames_used, 1)") == 0))
    added = F.when(F.col("slot") % 4 == 0, 4).when(F.col("slot") % 2 == 0, 8).otherwise(16)
    line = used.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("slot", added.alias("stage")))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat_ws(":", x.slot.cast("string"), x.stage.cast("string"))), ",")
    return d.join(line, "sample_id", "left").select("sample_id", "verdict", F.round("p_fake", 6).alias("p_fake"), F.round("confidence", 6).alias("confidence"), F.coalesce(text, F.lit("")).alias("timeline"))


@query("d7_evidence_frames", "frames", DECIDE_SQL + """, e AS (SELECT f.sample_id, f.slot, f.logit, CASE WHEN verdict = 'likely_manipulated' THEN 1 WHEN verdict = 'likely_real' THEN -1
  WHEN CASE d.frames_used WHEN 4 THEN score_4 WHEN 8 THEN score_8 WHEN 16 THEN score_16 END >= 0 THEN 1 ELSE -1 END AS sign FROM frames f JOIN decisions d USING (sample_id) WHERE d.frames_used > 0 AND f.slot % (16 // greatest(d.frames_used, 1)) = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY -sign * logit, slot) AS k FROM e) SELECT sample_id, sign, string_agg(CAST(slot AS VARCHAR), ',' ORDER BY slot) AS slots FROM top WHERE k <= 4 GROUP BY sample_id, sign""")
def _(get):
    return D.evidence(get("frames"), decisions_of(get)).select("sample_id", "sign", F.array_join(F.transform("evidence", lambda e: e.slot.cast("string")), ",").alias("slots"))


@query("p9_frame_flags", "frames", "SELECT sample_id, slot, q1 < 1.0 AS low_sharpness, q2 < 1.0 AS low_resolution, q3 > 3.0 AS high_compression FROM frames")
def _(get):
    flags = GATE.flags(F.col("q1"), F.col("q2"), F.col("q3"))
    return get("frames").select("sample_id", "slot", *[f.alias(c.lower()) for c, f in flags.items()])


@query("a22_score_agreement", "frames", f""", j AS (SELECT logit AS a, logit + 0.01 * (slot - 8) AS b FROM frames), k AS (SELECT *, {SIG.format('a')} AS pa, {SIG.format('b')} AS pb FROM j)
SELECT count(*) AS n, round(max(abs(a - b)), 8) AS max_logit, round(avg(abs(a - b)), 8) AS mean_logit, round(quantile_cont(abs(a - b), 0.99), 8) AS p99_logit, round(max(abs(pa - pb)), 8) AS max_p, round(avg(((a >= 0) = (b >= 0))::INT), 8) AS sign_agreement FROM k""")
def _(get):
    a = get("frames").select("sample_id", "slot", F.col("logit").alias("a"))
    b = get("frames").select("sample_id", "slot", (F.col("logit") + 0.01 * (F.col("slot") - 8)).alias("b"))
    both = a.join(b, ["sample_id", "slot"]).withColumn("gap", F.abs(F.col("a") - F.col("b")))
    sums = both.agg(
        F.count(F.lit(1)).alias("n"), F.max("gap").alias("max_logit"), F.avg("gap").alias("mean_logit"),
        F.max(F.abs(S.sigmoid("a") - S.sigmoid("b"))).alias("max_p"), F.avg(((F.col("a") >= 0) == (F.col("b") >= 0)).cast("double")).alias("sign_agreement"),
    )
    return sums.crossJoin(percentiles(both, "gap", {"p99_logit": 0.99}).drop("n"))  # one row each


@query("j6_score_alignment", "frames", """, f AS (SELECT sample_id, slot, sha256(sample_id || ':' || slot) AS crop FROM frames), b AS (SELECT sample_id, slot, sha256(CASE WHEN slot = 5 AND y = 0 THEN 'other:' ELSE '' END || sample_id || ':' || slot) AS crop, -logit AS l0, 0.01 * (slot - 8) AS l1 FROM frames WHERE NOT (slot = 3 AND y = 1))
SELECT coalesce(f.sample_id, b.sample_id) AS sample_id, coalesce(f.slot, b.slot) AS slot, CASE WHEN b.slot IS NULL THEN 'missing_score' WHEN f.slot IS NULL THEN 'unknown_crop' ELSE 'ok' END AS status, round(l1 - l0, 8) AS margin
FROM f FULL JOIN b ON f.sample_id = b.sample_id AND f.slot = b.slot AND f.crop = b.crop""")
def _(get):
    crop = F.sha2(F.concat_ws(":", "sample_id", F.col("slot").cast("string")), 256)
    f = get("frames")
    other = F.when((F.col("slot") == 5) & (F.col("y") == 0), F.sha2(F.concat_ws(":", F.lit("other"), "sample_id", F.col("slot").cast("string")), 256)).otherwise(crop)
    scores = f.filter(~((F.col("slot") == 3) & (F.col("y") == 1))).select("sample_id", "slot", other.alias("crop"), F.array(-F.col("logit"), 0.01 * (F.col("slot") - 8)).alias("logits"))
    return aligned_margins(f.select("sample_id", "slot", crop.alias("crop")), scores, ["sample_id", "slot", "crop"], "logits").drop("crop")


@query("j21_result_parity", "frames", """SELECT sample_id, slot, round(logit, 2) AS a, round(logit + 0.01 * (slot - 8), 2) AS b FROM frames WHERE round(logit, 2) IS DISTINCT FROM round(logit + 0.01 * (slot - 8), 2)""")
def _(get):
    a = get("frames").select("sample_id", "slot", F.round("logit", 2).alias("a"))
    b = get("frames").select("sample_id", "slot", F.round(F.col("logit") + 0.01 * (F.col("slot") - 8), 2).alias("b"))
    return a.join(b, ["sample_id", "slot"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))


@query("f2_distillation_loss", "frames", """SELECT sample_id, slot, round(0.5 * (greatest(logit, 0) + ln(1 + exp(-abs(logit))) - y * logit) + 2.0 * (greatest(logit / 2, 0) + ln(1 + exp(-abs(logit / 2))) - 1 / (1 + exp(-(logit + 0.1) / 2)) * (logit / 2)), 8) AS loss FROM frames""")
def _(get):
    return get("frames").select("sample_id", "slot", S.distillation_loss(F.col("y"), F.col("logit"), F.col("logit") + 0.1).alias("loss"))


@query("m8_metric_bundle_by_method", "frames", f""", v AS (SELECT sample_id, y, method, avg(logit) AS z FROM frames GROUP BY ALL), e AS (SELECT m.method, v.y, v.z FROM v JOIN (SELECT DISTINCT method FROM v WHERE y = 1) m ON v.method = m.method OR v.y = 0),
r AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY z) + (count(*) OVER (PARTITION BY method, z) - 1) / 2.0 AS rk, {SIG.format('z')} AS p FROM e)
SELECT method, count(*) AS n, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 8) AS auroc,
  round(avg(((p >= 0.5) = (y = 1))::INT), 8) AS accuracy, round(avg(-CASE WHEN y = 1 THEN ln(p + 1e-7) ELSE ln(1 - p + 1e-7) END), 8) AS nll, round(avg((p - y) * (p - y)), 8) AS brier FROM r GROUP BY method""")
def _(get):
    v = get("frames").groupBy("sample_id", "y", "method").agg(F.avg("logit").alias("z"))
    methods = v.filter("y = 1").select("method").distinct()
    # Originals are compared with every method: methods are few, and only originals are repeated.
    each = v.filter("y = 1").select("method", "y", "z").unionByName(v.filter("y = 0").select("y", "z").join(F.broadcast(methods)).select("method", "y", "z"))
    losses = M.point_losses(each, "y", S.sigmoid("z"), 1e-7, ["method"])
    n = each.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    return M.auroc(each, "y", "z", ["method"]).select("method", "auroc").join(losses, "method").join(n, "method")


@query("a20_teacher_quality", "frames", f"""SELECT y, count(*) AS n, round(avg({SIG.format('logit')}), 8) AS mean_p, round(avg(((logit >= 0) = (y = 1))::INT), 8) AS accuracy FROM frames GROUP BY y""")
def _(get):
    return get("frames").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg(S.sigmoid("logit")).alias("mean_p"), F.avg(((F.col("logit") >= 0).cast("int") == F.col("y")).cast("double")).alias("accuracy"))


@query("a12_class_method_weights", "frames", """, c AS (SELECT y, method, count(*) AS n FROM frames GROUP BY y, method), w AS (SELECT *, 1.0 / ((SELECT count(DISTINCT y) FROM c) * count(*) OVER (PARTITION BY y) * n) AS w FROM c)
SELECT f.sample_id, f.slot, round(w.w / (SELECT sum(w * n) FROM w), 8) AS weight FROM frames f JOIN w ON f.y = w.y AND f.method = w.method""")
def _(get):
    f = get("frames")
    c = f.groupBy("y", "method").agg(F.count(F.lit(1)).alias("n"))
    labels = c.agg(F.count_distinct("y").alias("labels"))
    per = c.groupBy("y").agg(F.count(F.lit(1)).alias("methods"))
    w = c.join(per, "y").crossJoin(labels).withColumn("w", 1 / (F.col("labels") * F.col("methods") * F.col("n")))
    total = w.agg(F.sum(F.col("w") * F.col("n")).alias("total"))
    w = w.crossJoin(total).select("y", "method", (F.col("w") / F.col("total")).alias("weight"))
    return f.join(F.broadcast(w), ["y", "method"]).select("sample_id", "slot", "weight")  # one row a class and method


@query("a10_frames_to_videos", "frames", "SELECT sample_id, count(*) = 16 AS complete, string_agg(CAST(slot AS VARCHAR), ',' ORDER BY slot) AS slots, round(avg(logit), 8) AS score FROM frames GROUP BY sample_id")
def _(get):
    rows = get("frames").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("slot", "logit"))).alias("f"), F.avg("logit").alias("score"))
    return rows.select("sample_id", (F.size("f") == 16).alias("complete"), F.array_join(F.transform("f", lambda x: x.slot.cast("string")), ",").alias("slots"), "score")


@query("a3_extraction_summary", "frames", """, v AS (SELECT sample_id, count(*) AS n, count(DISTINCT slot) AS d FROM frames GROUP BY sample_id) SELECT count(*) AS videos, CAST(sum(n) AS BIGINT) AS frames, count(*) FILTER (n = 16 AND d = 16) AS complete, bool_and(n = 16 AND d = 16) AS all_ordered FROM v""")
def _(get):
    v = get("frames").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), (F.sort_array(F.collect_list("slot")) == F.sequence(F.lit(0), F.lit(15))).alias("ok"))
    return v.agg(F.count(F.lit(1)).alias("videos"), F.sum("n").alias("frames"), F.count_if("ok").alias("complete"), F.bool_and("ok").alias("all_ordered"))


@query("a2_counts_by_method", "frames", "SELECT method, y, count(*) AS frames, count(DISTINCT sample_id) AS videos FROM frames GROUP BY method, y")
def _(get):
    return get("frames").groupBy("method", "y").agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("sample_id").alias("videos"))


@query("a2_frames_per_video", "frames", "SELECT n, count(*) AS videos FROM (SELECT sample_id, count(*) AS n FROM frames GROUP BY 1) t GROUP BY n")
def _(get):
    return get("frames").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("videos"))


STATISTICS_BY = ("y", "method", "slot", "q2", "q3")


@query("a5_detection_statistics", "frames", ", k AS (SELECT 'all' AS key, '' AS value, q1 FROM frames" + "".join(f" UNION ALL SELECT '{c}', CAST(CAST({c} AS INT) AS VARCHAR), q1 FROM frames" if c != "method" else " UNION ALL SELECT 'method', method, q1 FROM frames" for c in STATISTICS_BY) + ") SELECT key, value, count(*) AS n, round(avg(q1), 8) AS mean, min(q1) AS low, max(q1) AS high FROM k GROUP BY ALL")
def _(get):
    f = get("frames").withColumns({c: F.col(c).cast("int") for c in ("q2", "q3")})
    return M.statistics_by(f, "q1", STATISTICS_BY)


@query("k1_ordered_output", "frames", "SELECT sample_id, slot, row_number() OVER (PARTITION BY sample_id ORDER BY slot) AS nth FROM frames")
def _(get):
    return get("frames").select("sample_id", "slot", F.row_number().over(Window.partitionBy("sample_id").orderBy("slot")).alias("nth")).repartition("sample_id").sortWithinPartitions("sample_id", "slot")


@query("p2_protected_split_guard", "frames", "SELECT sample_id, slot FROM frames")
def _(get):
    split = F.when(F.col("y") == 0, "train").otherwise("val")
    return only_splits(get("frames").withColumn("split", split), ["train", "val"]).select("sample_id", "slot")


@query("p10_uncertain_reason", "frames", DECIDE_SQL + "SELECT sample_id, CASE WHEN reason LIKE 'insufficient%' THEN 'INSUFFICIENT_FACE_FRAMES' WHEN reason = 'final_k16_uncertain_empty' THEN 'ATYPICAL_INPUT' ELSE 'AMBIGUOUS_EVIDENCE' END AS code FROM decisions WHERE verdict = 'uncertain'")
def _(get):
    return decisions_of(get).filter(F.col("verdict") == D.UNCERTAIN).select("sample_id", D.uncertainty_code(F.col("reason")).alias("code"))


@query("j20_side_table_lookup", "frames prov", "SELECT asset_id, CAST(json_extract_string(manifest_json, '$.k') AS INT) AS k FROM prov WHERE concat('u', CAST(asset_id AS STRING), '_0') IN (SELECT sample_id FROM frames)")
def _(get):
    ids = get("frames").select("sample_id").distinct()
    kept = get("prov").join(ids, F.concat(F.lit("u"), F.col("asset_id").cast("string"), F.lit("_0")) == F.col("sample_id"), "left_semi")
    return kept.select("asset_id", F.from_json("manifest_json", "k int").getField("k").alias("k"))


@query("m18_calibrated_predict", "scored", f"""SELECT row_key, round(p, 8) AS p, {VERDICT} AS verdict FROM (SELECT *, p <= 0.6 AS in_real, 1 - p <= 0.5 AS in_fake FROM (SELECT *, {SIG.format('logit / 0.7')} AS p FROM scored) t) s""")
def _(get):
    # The calibration table has a row a level; it is joined as a column set of one level.
    table = get("scored").sparkSession.createDataFrame([("video_k8", 0.015, 0.7, 0.6, 0.5)], "level string, alpha double, temperature double, q_real double, q_fake double")
    rows = get("scored").crossJoin(F.broadcast(table.filter("level = 'video_k8' AND alpha = 0.015"))).withColumn("p", S.sigmoid(F.col("logit") / F.col("temperature")))
    return M.prediction_sets(rows, "p", F.col("q_real"), F.col("q_fake")).select("row_key", "p", "verdict")


@query("w3_running_error", "scored", RISK.replace("row_number() OVER", "row_key, row_number() OVER") + "SELECT row_key, k AS seen, err AS errors FROM e")
def _(get):
    from veraframe.operators.ordering import running

    rows = with_p(get("scored")).withColumn("conf", F.greatest(F.col("p"), 1 - F.col("p")))
    wrong = ((F.col("p") >= 0.5).cast("int") != F.col("y")).cast("long")
    return running(rows, [F.col("conf").desc(), F.col("row_key")], {"errors": wrong, "seen": F.lit(1).cast("long")}).select("row_key", "seen", "errors")


@query("m24_best_epoch", "epochs", """, b AS (SELECT *, struct_pack(m := metric, g := -nll) AS v, max(struct_pack(m := metric, g := -nll)) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best FROM epochs), l AS (SELECT *, lag(best) OVER (PARTITION BY run ORDER BY epoch) AS prev FROM b),
s AS (SELECT *, max(CASE WHEN coalesce(prev < v, true) THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best_at FROM l),
t AS (SELECT *, min(CASE WHEN epoch - best_at >= 10 THEN epoch END) OVER (PARTITION BY run) AS stopped_at FROM s)
SELECT run, max(best_at) AS best_epoch, round(max(best.m), 8) AS best_metric, max(stopped_at) AS stopped_at FROM t WHERE stopped_at IS NULL OR epoch <= stopped_at GROUP BY run""")
def _(get):
    return D.best_epoch(get("epochs"), "run", "epoch", "metric", 10, "nll")


@query("w5_best_so_far", "epochs", "SELECT run, epoch, round(max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING), 8) AS best FROM epochs")
def _(get):
    upto = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return get("epochs").select("run", "epoch", F.max("metric").over(upto).alias("best"))


@query("a15_latency_percentiles", "log", """, r AS (SELECT verdict, total_ms, row_number() OVER (PARTITION BY verdict ORDER BY total_ms) AS k, count(*) OVER (PARTITION BY verdict) AS n FROM log)
SELECT verdict, count(*) AS n, round(quantile_cont(total_ms, 0.5), 8) AS p50, round(quantile_cont(total_ms, 0.95), 8) AS p95, round(max(total_ms), 8) AS max_ms, round(max(CASE WHEN k = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1 THEN total_ms END), 8) AS nearest_p95 FROM r GROUP BY verdict""")
def _(get):
    log = get("log")
    exact = percentiles(log, "total_ms", {"p50": 0.5, "p95": 0.95, "max_ms": 1.0}, ["verdict"])
    return exact.join(percentiles(log, "total_ms", {"nearest_p95": 0.95}, ["verdict"], nearest=True).drop("n"), "verdict")


@query("a16_run_costs", "log", "SELECT user_id % 20 AS run, round(sum(total_ms), 6) AS total, round(median(total_ms), 8) AS median_ms, round(max(total_ms), 8) AS max_ms FROM log GROUP BY 1")
def _(get):
    log = get("log").withColumn("run", F.col("user_id") % 20)
    total = log.groupBy("run").agg(F.round(F.sum("total_ms"), 6).alias("total"))
    return total.join(percentiles(log, "total_ms", {"median_ms": 0.5, "max_ms": 1.0}, ["run"]).drop("n"), "run")
