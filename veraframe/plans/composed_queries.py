"""Queries of composed fits, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from veraframe.functions import extensions as X
from veraframe.functions import signals as SG
from veraframe.functions.scalars import unit_hash
from veraframe.functions.scoring import score_frames
from veraframe.operators import decisions as D
from veraframe.operators import fitting as C
from veraframe.operators import landmarks as L
from veraframe.operators import manifests as M
from veraframe.plans.media_queries import linear_scorer
from veraframe.plans.registry import registry
from veraframe.plans.score_queries import AUC, GATE_SQL, decisions_of, gated_of
from veraframe.sources import datasets as ds
from veraframe.sources import manifest_files as S
from veraframe.sources.shared import materialise, new_path

QUERIES, ORACLES, query = registry()


@query("m17_calibration_report")
def _(get):
    scores = D.stage_scores(get("frames"), [4, 8, 16], keep=["y"])
    parts = M.exact_partition(scores.select("sample_id"), "sample_id", (0.4, 0.3, 0.3), ("train", "temperature", "conformal"), 42)
    table = materialise(scores.join(parts, "sample_id"), "calibration")
    return C.calibration_report(table, ["score_4", "score_8", "score_16"], "y", "partition", 0.1)


@query("m19_bootstrap_delta")
def _(get):
    noise = unit_hash(F.concat(F.lit("n:"), F.col("row_key").cast("string")))
    return C.bootstrap_delta(get("scored").withColumn("other", F.col("logit") + noise), "row_key", "y", "logit", "other", 60, 5)


@query("m22_shortcut_probe")
def _(get):
    train = unit_hash(F.col("sample_id")) < 0.7
    return C.shortcut_probe(get("frames"), ["q1", "q2", "q3"], "y", train)


@query("a18_comparison_decision", "frames", GATE_SQL + """, m AS (SELECT method, avg(((verdict = 'likely_manipulated') = (y = 1))::INT) AS a, avg(((base_verdict = 'likely_manipulated') = (y = 1))::INT) AS b FROM final GROUP BY method)
SELECT round(min(a) - min(b), 8) AS worst_gain, round(avg(a) - avg(b), 8) AS mean_gain, min(a) > min(b) AND avg(a) > avg(b) AND max(b) FILTER (method = 'original') - max(a) FILTER (method = 'original') <= 0.01 AS accepted FROM m""")
def _(get):
    both = gated_of(get).join(decisions_of(get).select("sample_id", "y", "method"), "sample_id")
    share = lambda c: F.avg(((F.col(c) == D.FAKE) == (F.col("y") == 1)).cast("double"))
    m = both.groupBy("method").agg(share("verdict").alias("a"), share("base_verdict").alias("b"))
    clean = F.max(F.when(F.col("method") == "original", F.col("b"))) - F.max(F.when(F.col("method") == "original", F.col("a")))
    worst, mean = F.min("a") - F.min("b"), F.avg("a") - F.avg("b")
    return m.agg(worst.alias("worst_gain"), mean.alias("mean_gain"), ((worst > 0) & (mean > 0) & (clean <= 0.01)).alias("accepted"))


@query("a19_target_checks", "frames", GATE_SQL + """, totals AS (SELECT avg((verdict = 'likely_manipulated')::INT) FILTER (y = 0) AS fpr, avg((verdict = 'uncertain')::INT) AS abst, avg(frames_used) AS frames FROM final)
SELECT 'false_positive_rate' AS target, round(fpr, 8) AS value, fpr <= 0.05 AS met FROM totals UNION ALL SELECT 'abstention', round(abst, 8), abst <= 0.3 FROM totals UNION ALL SELECT 'avg_frames', round(frames, 8), frames <= 8 FROM totals""")
def _(get):
    both = gated_of(get).join(decisions_of(get).select("sample_id", "y"), "sample_id")
    s = D.verdict_summary(both)
    limits = {"false_positive_rate": 0.05, "abstention": 0.3, "avg_frames": 8.0}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("target"), F.col(k).alias("value"), (F.col(k) <= v).alias("met")) for k, v in limits.items()]))
    return s.select(each.alias("t")).select("t.*")


@query("f7_similarity_transform", "thumbs", """, p AS (SELECT vec_id, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y, CAST(embedding[2 * i + 11] AS DOUBLE) AS u, CAST(embedding[2 * i + 12] AS DOUBLE) AS v FROM thumbs, range(5) r(i)),
c AS (SELECT vec_id, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, u - avg(u) OVER w AS u, v - avg(v) OVER w AS v FROM p WINDOW w AS (PARTITION BY vec_id)), t AS (SELECT vec_id, sum(x * u) + sum(y * v) AS d, sum(x * v) - sum(y * u) AS k, sum(x * x) + sum(y * y) AS s, sum(u * u) + sum(v * v) AS g FROM c GROUP BY 1)
SELECT vec_id, round(sqrt(d * d + k * k) / s, 6) AS scale, round(atan2(k, d), 6) AS angle, round(sqrt(greatest(0, g - (d * d + k * k) / s) / 5), 6) AS residual FROM t""")
def _(get):
    part = lambda at: F.transform(F.sequence(F.lit(at), F.lit(at + 8), F.lit(2)), lambda i: F.get("embedding", i).cast("double"))
    # The points are written as columns first, since each is used several times.
    t = get("thumbs").select("vec_id", part(0).alias("xs"), part(1).alias("ys"), part(10).alias("xd"), part(11).alias("yd"))
    fit = C.similarity_transform(F.col("xs"), F.col("ys"), F.col("xd"), F.col("yd"))
    return t.select("vec_id", *[F.round(v, 6).alias(k) for k, v in fit.items()])


@query("s3_manifest_sink", "samples", "SELECT sample_id, source_id, label FROM samples")
def _(get):
    s = get("samples").select("sample_id", "source_id", "label", "media_type")
    path = new_path(s.sparkSession, "manifest")
    S.write_manifest(s, path)
    return S.read_manifest_files(s.sparkSession, path).select("sample_id", "source_id", "label")


@query("s10_split_tables", "samples", "SELECT sample_id, label FROM samples WHERE split = 'val'")
def _(get):
    s = get("samples")
    path = new_path(s.sparkSession, "splits")
    S.write_by_split(s, path, "split", ["sample_id"], ["sample_id", "label"])
    return s.sparkSession.read.parquet(path).filter("split = 'val'").select("sample_id", "label")


@query("s12_score_cache", "thumbs", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v, i: CAST(v AS DOUBLE) * CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END)), 6) AS logit FROM thumbs")
def _(get):
    t = get("thumbs")
    path = new_path(t.sparkSession, "score-cache")
    score = lambda df: score_frames(df, "embedding", linear_scorer, ["vec_id"])
    S.cached_scores(t.filter("label < 5"), ["vec_id"], path, "linear-1", score)
    return S.cached_scores(t, ["vec_id"], path, "linear-1", score).select("vec_id", F.round("logit", 6).alias("logit"))


@query("s11_run_log_flatten", "log", "SELECT event_id, verdict AS \"outcome.verdict\", round(total_ms, 8) AS \"outcome.ms\" FROM log")
def _(get):
    nested = get("log").select("event_id", F.struct("verdict", F.round("total_ms", 8).alias("ms")).alias("outcome"))
    return S.dotted(nested).select("event_id", "`outcome.verdict`", "`outcome.ms`")


@query("x6_grouped_auroc", "scored", "SELECT method, auroc FROM (" + AUC.format(by="method,", part="PARTITION BY method", parts="method,", group="GROUP BY method") + ") a")
def _(get):
    return X.grouped_auroc(get("scored"), ["method"], "y", "logit")


@query("x3_byte_logits", "docs", "SELECT doc_id, CAST(strlen(text) % 5 - strlen(text) % 7 AS DOUBLE) AS margin FROM docs")
def _(get):
    docs = get("docs").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return X.score_bytes(docs, ["doc_id"], "content", lambda bs: [(len(b) % 7, len(b) % 5) for b in bs]).select("doc_id", "margin")


@query("x4_detections", "thumbs", ", e AS (SELECT vec_id, CAST(unnest(range(64)) AS INT) AS det, CAST(unnest(embedding) AS DOUBLE) AS confidence FROM thumbs) SELECT vec_id, det, round(confidence, 8) AS confidence FROM e WHERE confidence > 0.2")
def _(get):
    return X.detect(get("thumbs"), ["vec_id"], "embedding", lambda v: ((i, x) for i, x in enumerate(v) if x > 0.2))


CI = "count(*) AS n, round(avg({v}), 8) AS mean, round(avg({v}) - 1.96 * stddev_samp({v}) / sqrt(count(*)), 8) AS low, round(avg({v}) + 1.96 * stddev_samp({v}) / sqrt(count(*)), 8) AS high"


@query("j17_landmark_check", "marks", """, p AS (SELECT f.method, CASE WHEN f.source_width = r.source_width THEN 'same' ELSE 'changed' END AS width, (f.lx2 - f.lx1) / (r.lx2 - r.lx1) AS a, (f.lx1 + f.lx2) / 2 - (r.lx1 + r.lx2) / 2 + (r.source_width - f.source_width) / 2 AS b, f.source_width / r.source_width AS c
  FROM marks f JOIN marks r ON f.family_id = r.family_id AND f.slot = r.slot AND f.frame_index = r.frame_index WHERE f.label = 'fake' AND r.label = 'real' AND r.lx2 > r.lx1), m AS (SELECT method, width, 'interocular_ratio' AS measure, a AS v FROM p UNION ALL SELECT method, width, 'eye_mid_shift', b FROM p UNION ALL SELECT method, width, 'squeeze_predicted_ratio', c FROM p)
SELECT method, width, measure, """ + CI.format(v="v") + " FROM m GROUP BY ALL")
def _(get):
    return L.landmark_check(get("marks"))


GEOMETRY = """, g AS (SELECT family_id, label, avg((lx2 - lx1) / ((ly4 + ly5) / 2 - (ly1 + ly2) / 2)) AS width_height_ratio, avg((lx5 - lx4) / (lx2 - lx1)) AS mouth_to_eye_width, avg((lx3 - (lx1 + lx2) / 2) / (lx2 - lx1)) AS nose_x_offset, avg(w / h) AS detector_box_aspect, """ + ", ".join(
    f"avg(l{c}{i} - {v!r}) AS residual_{name}_{c}" for i, (name, p) in enumerate(zip(L.POINTS, L.template(), strict=True), 1) for c, v in zip("xy", p, strict=True)
) + " FROM marks GROUP BY ALL)"
GEOMETRY_NAMES = ["width_height_ratio", "mouth_to_eye_width", "nose_x_offset", "detector_box_aspect"]


@query("f8_geometry_features", "marks", GEOMETRY + " SELECT family_id, label, " + ", ".join(f"round({c}, 6) AS {c}" for c in [*GEOMETRY_NAMES, *(f"residual_{p}_{c}" for p in L.POINTS for c in "xy")]) + " FROM g")
def _(get):
    out = L.geometry_features(get("marks"), ["family_id", "label"], L.template())
    return out.select("family_id", "label", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("f8_geometry_differences", "marks", GEOMETRY + ", d AS (" + " UNION ALL ".join(f"SELECT f.family_id % 4 AS method, '{c}' AS feature, f.{c} - r.{c} AS v FROM g f JOIN g r ON f.family_id = r.family_id WHERE f.label = 'fake' AND r.label = 'real'" for c in GEOMETRY_NAMES) + ") SELECT method, feature, " + CI.format(v="v") + " FROM d GROUP BY ALL")
def _(get):
    feats = L.geometry_features(get("marks"), ["family_id", "label"], L.template()).withColumn("method", F.col("family_id") % 4)
    return L.paired_differences(feats, "family_id", "label", ["method"], GEOMETRY_NAMES)


@query("s6_known_dataset", "clip_files", """, b AS (SELECT 'faceforensics++:' || path AS sample_id, path, regexp_extract(path, '([^/]+)\\.mp4$', 1) AS stem, CASE WHEN path LIKE 'original%' THEN 'real' ELSE 'fake' END AS label, CASE WHEN path LIKE 'original%' THEN NULL ELSE split_part(path, '/', 2) END AS method, split_part(path, '/', 3) AS level FROM clip_files WHERE path NOT LIKE 'other/%'),
n AS (SELECT *, CASE WHEN label = 'fake' AND stem LIKE '%\\_%' ESCAPE '\\' THEN split_part(stem, '_', 1) END AS t, CASE WHEN label = 'fake' AND stem LIKE '%\\_%' ESCAPE '\\' THEN split_part(stem, '_', 2) END AS d FROM b)
SELECT n.sample_id, n.label, coalesce(t, n.stem) AS source_id, n.method AS generator_method, CASE WHEN n.method IN ('Deepfakes', 'FaceSwap') THEN 'face-swap' WHEN n.method IS NOT NULL THEN 'reenactment' END AS manipulation_family, n.level AS compression_level, x.sample_id AS parent_sample_id, y.sample_id AS paired_sample_id
FROM n LEFT JOIN b x ON x.label = 'real' AND x.stem = t AND x.level = n.level LEFT JOIN b y ON y.label = 'real' AND y.stem = d AND y.level = n.level""")
def _(get):
    files = get("clip_files").withColumn("checksum_sha256", F.lit(None).cast("string"))
    return ds.folder_samples(files, ds.dataset_spec("faceforensics++", "v1")).select("sample_id", "label", "source_id", "generator_method", "manipulation_family", "compression_level", "parent_sample_id", "paired_sample_id")


@query("s4_sidecar_files", "sidecar", """SELECT 'side:' || path AS sample_id, CASE label WHEN '1' THEN 'fake' ELSE 'real' END AS label, regexp_extract(path, '([^/]+)\\.mp4$', 1) AS source_id, 'side:' || original AS parent_sample_id FROM sidecar WHERE label IN ('0', '1')""")
def _(get):
    rows = get("sidecar")
    out = new_path(rows.sparkSession, "sidecar")
    rows.write.json(out)
    spec = ds.generic_spec("side", "1", parent="original")
    return ds.sidecar_samples(ds.read_sidecar(rows.sparkSession, out, "jsonl"), spec).select("sample_id", "label", "source_id", "parent_sample_id")


def enlarged_signals(grey):
    """The signals of a picture of 8 x 8 squares of 28 pixels."""
    return SG.signals_hybrid(grey.repeat(28, axis=0).repeat(28, axis=1))


@query("x2_frame_signals")
def _(get):
    small = get("thumbs").select("vec_id", SG.as_grey(F.col("embedding")).alias("pixels"))
    return SG.frame_signals(small, "pixels", 8, ["vec_id"], SG.SIGNALS_V2, enlarged_signals)


@query("x5_stress_matrix")
def _(get):
    small = get("thumbs").select("vec_id", SG.as_grey(F.col("embedding")).alias("pixels"))
    mean = F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v) / 64
    return SG.stress_matrix(small, "pixels", 8, ["vec_id"]).groupBy("condition", "severity").agg(F.count(F.lit(1)).alias("n"), F.avg(mean).alias("mean_grey"))


@query("p3_whitelisted_rows", "frames", 'SELECT sample_id, slot, y AS "metadata.label", method AS "metadata.method" FROM frames')
def _(get):
    rows = get("frames").select("sample_id", "slot", F.struct(F.col("y").alias("label"), "method").alias("metadata"))
    return S.dotted(S.whitelisted(rows, {"sample_id", "slot", "metadata.label", "metadata.method"}))


@query("f13_nested_flatten", "samples", 'SELECT sample_id, source_id AS "origin.source", identity_id AS "origin.who.identity", split AS "origin.who.place.split", label FROM samples')
def _(get):
    who = F.struct(F.col("identity_id").alias("identity"), F.struct("split").alias("place"))
    return S.dotted(get("samples").select("sample_id", F.struct(F.col("source_id").alias("source"), who.alias("who")).alias("origin"), "label"))
