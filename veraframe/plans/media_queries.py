"""Queries over detections, media facts, embeddings, provenance and documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veraframe.functions import scalars as S
from veraframe.functions.scoring import score_frames, score_in_waves
from veraframe.operators import near_duplicates as D
from veraframe.operators import tracking as T
from veraframe.operators.decisions import Stage
from veraframe.operators.ordering import percentiles
from veraframe.plans.registry import registry

QUERIES, ORACLES, query = registry()


def n_rows():
    return F.count(F.lit(1)).alias("n")


@query("k2_primary_face", "faces", "SELECT video_id, arg_max(det_key, struct_pack(c := confidence, a := w * h, k := -det_key)) AS det_key, round(max(confidence), 8) AS confidence FROM faces GROUP BY video_id")
def _(get):
    return T.primary_face(get("faces"), ["video_id"]).select("video_id", "det_key", "confidence")


@query("f5_box_overlap", "faces", """, p AS (SELECT a.video_id, a.frame_index, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s FROM faces a JOIN faces b ON a.video_id = b.video_id AND b.frame_index = a.frame_index + 1)
SELECT video_id, frame_index, round(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END, 8) AS iou FROM p""")
def _(get):
    f = get("faces")
    nxt = f.select("video_id", (F.col("frame_index") - 1).alias("frame_index"), *[F.col(c).alias(f"{c}2") for c in "xywh"])
    return f.join(nxt, ["video_id", "frame_index"]).select("video_id", "frame_index", S.iou("x", "y", "w", "h", "x2", "y2", "w2", "h2").alias("iou"))


@query("f5_box_geometry", "faces", """, e AS (SELECT det_key, x - w * 0.25 AS x, y - h * 0.25 AS y, w * 1.5 AS w, h * 1.5 AS h FROM faces), c AS (SELECT det_key, least(greatest(x, 0.0), 200.0) AS x1, least(greatest(y, 0.0), 30.0) AS y1, least(greatest(x + w, 0.0), 200.0) AS x2, least(greatest(y + h, 0.0), 30.0) AS y2 FROM e)
SELECT det_key, round(x1, 8) AS x, round(y1, 8) AS y, round(greatest(x2 - x1, 0.0), 8) AS w, round(greatest(y2 - y1, 0.0), 8) AS h, round(greatest(x2 - x1, 0.0) * greatest(y2 - y1, 0.0), 8) AS area FROM c""")
def _(get):
    box = S.clipped(*S.expanded(*[F.col(c) for c in "xywh"], 0.25), F.lit(200.0), F.lit(30.0))
    return get("faces").select("det_key", *[v.alias(c) for c, v in zip("xywh", box, strict=True)], S.area(box[2], box[3]).alias("area"))


@query("f6_link_score", "faces", """, p AS (SELECT a.video_id, a.frame_index, a.det_key, b.det_key AS next_key, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h AS s, b.w * b.h AS t,
  sqrt(pow(a.x + a.w / 2 - b.x - b.w / 2, 2) + pow(a.y + a.h / 2 - b.y - b.h / 2, 2)) / ((a.w + b.w) / 2) AS shift FROM faces a JOIN faces b ON a.video_id = b.video_id AND b.frame_index = a.frame_index + 1)
SELECT video_id, frame_index, det_key, next_key, round(CASE WHEN i / (s + t - i) >= 0.3 THEN 1 + i / (s + t - i) WHEN shift <= 1 AND greatest(s, t) / least(s, t) <= 2.25 THEN 1 - shift / (1 + 1e-9) + 1e-6 ELSE 0 END, 8) AS score FROM p""")
def _(get):
    f = get("faces").select("video_id", "frame_index", "det_key", *"xywh")
    nxt = f.select("video_id", (F.col("frame_index") - 1).alias("frame_index"), F.col("det_key").alias("next_key"), *[F.col(c).alias(f"{c}2") for c in "xywh"])
    return f.join(nxt, ["video_id", "frame_index"]).select("video_id", "frame_index", "det_key", "next_key", T.link_score([F.col(c) for c in "xywh"], [F.col(f"{c}2") for c in "xywh"]).alias("score"))


@query("f6_landmark_distance", "faces", "SELECT a.video_id, a.det_key, b.det_key AS next_key, round(" + " + ".join(f"sqrt(pow(a.lx{i} - b.lx{i}, 2) + pow(a.ly{i} - b.ly{i}, 2))" for i in range(1, 6)) + ", 8) AS distance FROM faces a JOIN faces b ON a.video_id = b.video_id AND b.frame_index = a.frame_index + 1")
def _(get):
    f = get("faces").select("video_id", "frame_index", "det_key", *T.LANDMARKS)
    nxt = f.select("video_id", (F.col("frame_index") - 1).alias("frame_index"), F.col("det_key").alias("next_key"), *[F.col(c).alias(f"next_{c}") for c in T.LANDMARKS])
    return f.join(nxt, ["video_id", "frame_index"]).select("video_id", "det_key", "next_key", T.landmark_distance(T.LANDMARKS, [f"next_{c}" for c in T.LANDMARKS]).alias("distance"))


@query("p8_small_faces", "faces", "SELECT video_id, count(*) FILTER (least(w, h) >= 24) AS kept, bool_or(least(w, h) < 24) AS dropped FROM faces GROUP BY 1")
def _(get):
    small = F.least("w", "h") < 24
    return get("faces").groupBy("video_id").agg(F.count_if(~small).alias("kept"), F.bool_or(small).alias("dropped"))


@query("w4_neighbour_gaps", "faces", "SELECT video_id, max(nxt - frame_index) AS max_gap FROM (SELECT video_id, frame_index, lead(frame_index) OVER (PARTITION BY video_id ORDER BY frame_index) AS nxt FROM (SELECT DISTINCT video_id, frame_index FROM faces) f) t GROUP BY 1")
def _(get):
    w = Window.partitionBy("video_id").orderBy("frame_index")
    return get("faces").select("video_id", "frame_index").distinct().withColumn("gap", F.lead("frame_index").over(w) - F.col("frame_index")).groupBy("video_id").agg(F.max("gap").alias("max_gap"))


@query("j12_nearest_frame", "faces", """, v AS (SELECT DISTINCT video_id, unnest([2, 4, 9, 30]) AS at_pos FROM faces)
SELECT v.video_id, at_pos, min_by(frame_index, struct_pack(d := abs(frame_index - at_pos), f := frame_index)) AS nearest FROM v LEFT JOIN faces k ON v.video_id = k.video_id GROUP BY ALL""")
def _(get):
    f = get("faces")
    wanted = f.select("video_id").distinct().withColumn("at_pos", F.explode(F.array(*map(F.lit, (2, 4, 9, 30)))))
    return T.nearest_frame(wanted, f, at="at_pos")


@query("j12_face_at")
def _(get):
    f = get("faces")
    wanted = f.select("video_id", F.col("frame_index").alias("at")).distinct()
    return T.face_at(wanted, f, T.link_tracks(f))


@query("j10_face_links")
def _(get):
    return T.link_tracks(get("faces"))


@query("j11_gap_tracker")
def _(get):
    return T.track_faces(get("faces"))


@query("j11_track_report")
def _(get):
    return T.track_report(T.track_faces(get("faces")))


@query("k3_primary_track")
def _(get):
    return T.primary_tracks(T.link_tracks(get("faces")))


#: Three planned frames of ten, with the offsets that half of the gaps, the video's ends and a reach of two allow.
PLANNED, PLAN_COUNT = [1, 4, 8], 10
TRIES = "(VALUES (0, 0, 1), (0, 1, 2), (0, 2, 0), (1, 0, 4), (1, 1, 5), (1, 2, 3), (2, 0, 8), (2, 1, 9), (2, 2, 7)) t(slot, rank, f)"


@query("d8_slot_resolution", "faces", f""", v AS (SELECT DISTINCT video_id, det_key2 % 2 AS m, frame_index AS f FROM faces), mem AS (SELECT DISTINCT video_id, m FROM v), n AS (SELECT video_id, count(*) AS members FROM mem GROUP BY 1),
h AS (SELECT v.video_id, m, slot, rank, t.f AS f FROM v JOIN {TRIES} ON t.f = v.f), j AS (SELECT h.video_id, slot, min(rank) AS rank, min_by(f, rank) AS f FROM (SELECT video_id, slot, rank, f, count(*) AS have FROM h GROUP BY ALL) h JOIN n ON n.video_id = h.video_id WHERE have = members GROUP BY ALL),
o AS (SELECT video_id, m, slot, min_by(f, rank) AS f FROM h GROUP BY ALL), e AS (SELECT mem.video_id, mem.m, s.slot, j.rank, coalesce(j.f, o.f) AS f FROM mem CROSS JOIN (VALUES (0), (1), (2)) s(slot) LEFT JOIN j ON j.video_id = mem.video_id AND j.slot = s.slot LEFT JOIN o ON o.video_id = mem.video_id AND o.m = mem.m AND o.slot = s.slot)
SELECT video_id, slot, CASE WHEN min(rank) = 0 THEN 'planned' WHEN min(rank) > 0 THEN 'joint' WHEN count(f) = count(*) THEN 'individual' ELSE 'failed' END AS mode, string_agg(m || ':' || coalesce(CAST(f AS VARCHAR), '-'), ',' ORDER BY m) AS frames FROM e GROUP BY video_id, slot""")
def _(get):
    valid = get("faces").withColumn("member", F.col("det_key2") % 2)
    shown = F.array_join(F.transform("frames", lambda x: F.concat(x.member.cast("string"), F.lit(":"), F.coalesce(x.frame.cast("string"), F.lit("-")))), ",")
    return T.resolve_slots(valid, PLANNED, PLAN_COUNT).withColumn("frames", shown)


@query("p4_media_buckets", "media", """SELECT media_id, CASE WHEN duration_s >= 0 AND duration_s < 10 THEN '<10s' WHEN duration_s < 20 THEN '10-20s' WHEN duration_s < 30 THEN '20-30s' WHEN duration_s < 45 THEN '30-45s' ELSE '>=45s' END AS duration_bucket,
CASE WHEN (width, height) IN ((1280, 720), (640, 480), (1920, 1080), (854, 480)) THEN width || 'x' || height WHEN height IN (480, 720, 1080) THEN 'other-' || height || 'p' ELSE 'other' END AS resolution_bucket FROM media""")
def _(get):
    return get("media").select("media_id", S.duration_bucket(F.col("duration_s")).alias("duration_bucket"), S.resolution_bucket(F.col("width"), F.col("height")).alias("resolution_bucket"))


@query("p5_frame_budget", "media", "SELECT media_id, CASE WHEN duration_s IS NULL THEN 1 WHEN duration_s <= 3 THEN 4 WHEN duration_s <= 15 AND duration_s <= 8 THEN 8 WHEN duration_s <= 15 THEN 8 ELSE 16 END AS budget FROM media")
def _(get):
    d = F.col("duration_s")
    return get("media").select("media_id", F.when(d.isNull(), 1).when(d <= 3, 4).when(d <= 15, 8).otherwise(16).alias("budget"))


@query("d9_frame_plan", "media", """, m AS (SELECT media_id, frame_count AS n, least(16, frame_count) AS m FROM media), e AS (SELECT media_id, n, m, unnest(range(m)) AS i FROM m)
SELECT media_id, string_agg(CAST(f AS VARCHAR), ',' ORDER BY f) AS frames FROM (SELECT DISTINCT media_id, CASE WHEN m = 1 THEN 0 ELSE CAST(round_even(i * (n - 1) / (m - 1), 0) AS BIGINT) END AS f FROM e) t GROUP BY 1""")
def _(get):
    n = F.col("frame_count")
    m = F.least(F.lit(16), n)
    plan = F.when(m == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.bround(i * (n - 1) / (m - 1)).cast("long"))))
    return get("media").filter("frame_count > 0").select("media_id", F.array_join(F.transform(plan, lambda x: x.cast("string")), ",").alias("frames"))


@query("f9_frame_rate", "media", """SELECT media_id, round(frame_count / NULLIF(duration_s, 0), 8) AS fps, round(30000 / 1001.0, 8) AS ntsc, (media_id * 90) % 360 AS rotation, abs(frame_count / NULLIF(duration_s, 0) - 25.0) > 0.5 AS vfr FROM media""")
def _(get):
    text = F.concat_ws("/", F.col("frame_count").cast("string"), F.col("duration_s").cast("string"))
    fps = S.frame_rate(text)
    return get("media").select("media_id", fps.alias("fps"), S.frame_rate(F.lit("30000/1001")).alias("ntsc"), F.pmod(F.col("media_id") * 90, F.lit(360)).alias("rotation"), (F.abs(fps - 25.0) > 0.5).alias("vfr"))


@query("s9_media_validation", "media", """, k AS (SELECT *, CASE WHEN header_hex LIKE 'FFD8FF%' THEN '.jpg' WHEN header_hex LIKE '89504E47%' THEN '.png' WHEN substr(header_hex, 9, 8) = '66747970' THEN '.mp4' END AS kind FROM media)
SELECT media_id, concat_ws(',', CASE WHEN frame_count = 0 THEN 'empty' END, CASE WHEN ext NOT IN ('.jpg', '.png', '.mp4') THEN 'extension' END, CASE WHEN kind IS NULL THEN 'signature' END, CASE WHEN kind <> ext THEN 'mismatch' END, CASE WHEN duration_s > 30 THEN 'too_long' END) AS codes FROM k""")
def _(get):
    h = F.col("header_hex")
    kind = F.when(h.startswith("FFD8FF"), ".jpg").when(h.startswith("89504E47"), ".png").when(F.substring(h, 9, 8) == "66747970", ".mp4")
    checks = {"empty": F.col("frame_count") == 0, "extension": ~F.col("ext").isin(".jpg", ".png", ".mp4"), "signature": kind.isNull(), "mismatch": kind != F.col("ext"), "too_long": F.col("duration_s") > 30}
    return get("media").select("media_id", F.concat_ws(",", *[F.when(v, k) for k, v in checks.items()]).alias("codes"))


@query("f4_average_hash", "thumbs", "SELECT vec_id, list_aggregate(list_transform(embedding, lambda v: CASE WHEN CAST(v AS DOUBLE) > list_sum(list_transform(embedding, lambda u: CAST(u AS DOUBLE))) / 64 THEN 1 ELSE 0 END), 'string_agg', '') AS bits FROM thumbs")
def _(get):
    return get("thumbs").select("vec_id", F.array_join(F.transform(S.average_hash(F.col("embedding")), lambda b: b.cast("string")), "").alias("bits"))


#: The embeddings, and for every fourth a near copy with two values turned round.
BITS = """, two AS (SELECT vec_id, embedding FROM thumbs UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda v, i: CASE WHEN i IN (vec_id % 64 + 1, vec_id * 7 % 64 + 1) THEN -v ELSE v END) FROM thumbs WHERE vec_id % 4 = 0),
h AS (SELECT vec_id, list_aggregate(list_transform(embedding, lambda v: CASE WHEN CAST(v AS DOUBLE) > list_sum(list_transform(embedding, lambda u: CAST(u AS DOUBLE))) / 64 THEN 1 ELSE 0 END), 'string_agg', '') AS bits FROM two)"""


def hashes(get) -> DataFrame:
    t = get("thumbs").select("vec_id", "embedding")
    turned = F.transform("embedding", lambda v, i: F.when((i == F.col("vec_id") % 64) | (i == F.col("vec_id") * 7 % 64), -v).otherwise(v))
    two = t.unionByName(t.filter("vec_id % 4 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), turned.alias("embedding")))
    return two.select("vec_id", S.bits_to_long(S.average_hash(F.col("embedding"))).alias("h"))


@query("j9_hamming_pairs", "thumbs", BITS + ", d AS (SELECT min(vec_id) AS r, bits FROM h GROUP BY bits) SELECT a.r AS a, b.r AS b, CAST(hamming(a.bits, b.bits) AS INT) AS distance FROM d a JOIN d b ON a.r < b.r AND hamming(a.bits, b.bits) <= 5 UNION ALL SELECT d.r, h.vec_id, 0 FROM h JOIN d USING (bits) WHERE h.vec_id <> d.r")
def _(get):
    return D.hamming_pairs(hashes(get), "vec_id", "h", 5)


@query("j9_leader_groups")
def _(get):
    return D.hamming_groups(hashes(get), "vec_id", "h", 5)


@query("l7_exact_duplicates", "docs", "SELECT sha256(text) AS checksum, count(*) AS n, min(doc_id) AS first_id FROM docs GROUP BY 1 HAVING count(*) > 1")
def _(get):
    return get("docs").groupBy(F.sha2("text", 256).alias("checksum")).agg(n_rows(), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("l8_duplicate_report", "docs thumbs", BITS + ", d AS (SELECT min(vec_id) AS r, bits FROM h GROUP BY bits) SELECT 'exact' AS kind, CAST(min(doc_id) AS BIGINT) AS first_id, count(*) AS n FROM docs GROUP BY text HAVING count(*) > 1 UNION ALL SELECT 'near', a.r, count(*) FROM d a JOIN d b ON a.r < b.r AND hamming(a.bits, b.bits) <= 5 GROUP BY a.r")
def _(get):
    exact = get("docs").groupBy(F.sha2("text", 256).alias("c")).agg(F.min("doc_id").alias("first_id"), n_rows()).filter("n > 1").select(F.lit("exact").alias("kind"), "first_id", "n")
    near = D.hamming_pairs(hashes(get), "vec_id", "h", 5).filter("distance > 0").groupBy(F.col("a").alias("first_id")).agg(n_rows())
    return exact.unionByName(near.select(F.lit("near").alias("kind"), "first_id", "n"))


@query("a23_mean_embedding", "thumbs", ", f AS (SELECT vec_id // 16 AS video, embedding FROM thumbs), e AS (SELECT video, unnest(range(64)) AS dim, unnest(embedding) AS v FROM f WHERE video IN (SELECT video FROM f GROUP BY 1 HAVING count(*) = 16)) SELECT video, dim, round(avg(CAST(v AS DOUBLE)), 8) AS mean FROM e GROUP BY ALL")
def _(get):
    f = get("thumbs").select(F.expr("vec_id div 16").alias("video"), "embedding")
    full = f.groupBy("video").agg(n_rows()).filter("n = 16").select("video")
    each = f.join(full, "video", "left_semi").select("video", F.posexplode("embedding").alias("dim", "v"))
    return each.groupBy("video", F.col("dim").cast("long").alias("dim")).agg(F.avg(F.col("v").cast("double")).alias("mean"))


@query("s13_embedding_validation", "thumbs", "SELECT vec_id, len(embedding) = 64 AS shape_ok, list_count(list_filter(embedding, lambda v: isfinite(v))) = 64 AS finite FROM thumbs")
def _(get):
    ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return get("thumbs").select("vec_id", (F.size("embedding") == 64).alias("shape_ok"), ok.alias("finite"))


def linear_scorer(x: np.ndarray) -> np.ndarray:
    """A stand-in for a model: a fixed direction on the embedding."""
    return x.astype(np.float64) @ np.where(np.arange(x.shape[1]) % 2 == 0, 1.0, -1.0)


@query("x1_frame_scorer", "thumbs", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v, i: CAST(v AS DOUBLE) * CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END)), 6) AS logit FROM thumbs")
def _(get):
    return score_frames(get("thumbs"), "embedding", linear_scorer, ["vec_id"]).select("vec_id", F.round("logit", 6).alias("logit"))


@query("d5_scoring_waves")
def _(get):
    f = get("thumbs").select(F.expr("vec_id div 16").alias("sample_id"), (F.col("vec_id") % 16).cast("int").alias("slot"), "embedding")
    stages = [Stage(4, 0.015, 0.8, 0.42, 0.45), Stage(8, 0.015, 0.7, 0.42, 0.45), Stage(16, 0.02, 0.6, 0.5, 0.5)]
    return score_in_waves(f, "embedding", linear_scorer, stages).select("sample_id", "verdict", "reason", "frames_used")


@query("m26_rank_agreement", "thumbs", """, p AS (SELECT a.vec_id, unnest(range(64)) AS i, unnest(a.embedding) AS x, unnest(b.embedding) AS y FROM thumbs a JOIN thumbs b ON b.vec_id = a.vec_id + 1), r AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY x, i) AS rx, row_number() OVER (PARTITION BY vec_id ORDER BY y, i) AS ry FROM p)
SELECT vec_id, round(corr(rx, ry), 8) AS rho FROM r GROUP BY 1""")
def _(get):
    t = get("thumbs").select("vec_id", "embedding")
    both = t.join(t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    items = both.select("vec_id", F.explode(F.arrays_zip("embedding", "other", F.sequence(F.lit(0), F.lit(63)).alias("i"))).alias("z")).select("vec_id", "z.*")
    rank = lambda c: F.row_number().over(Window.partitionBy("vec_id").orderBy(c, "i"))
    return items.withColumns({"rx": rank("embedding"), "ry": rank("other")}).groupBy("vec_id").agg(F.corr("rx", "ry").alias("rho"))


@query("f12_provenance_flatten", "prov", "SELECT asset_id, CAST(json_extract_string(manifest_json, '$.k') AS INT) AS k, CAST(json_extract_string(manifest_json, '$.k') AS INT) % 2 = 0 AS ai_declared FROM prov")
def _(get):
    k = F.from_json("manifest_json", "k int").getField("k")
    return get("prov").select("asset_id", k.alias("k"), (k % 2 == 0).alias("ai_declared"))


STATUS = {"view": "valid", "click": "trusted", "purchase": "absent", "error": "error"}


@query("d10_provenance_status", "prov", "SELECT CASE status_raw " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " ELSE 'unsupported' END AS status, count(*) AS n FROM prov GROUP BY 1")
def _(get):
    table = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return get("prov").groupBy(F.coalesce(F.try_element_at(table, F.col("status_raw")), F.lit("unsupported")).alias("status")).agg(n_rows())


@query("f11_display_safe", "docs", r""", c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\p{C}', '', 'g'), '\p{Z}+', ' ', 'g')) AS t FROM docs)
SELECT doc_id, CASE WHEN t <> '' AND NOT regexp_matches(t, '__URLISH__') THEN substr(t, 1, 120) || CASE WHEN length(t) > 120 THEN '…' ELSE '' END END AS shown FROM c""".replace("__URLISH__", S.URLISH))
def _(get):
    return get("docs").select("doc_id", S.display_safe(F.col("text")).alias("shown"))


UNIT = "(CAST(('0x' || substr(sha256({}), 1, 13)) AS BIGINT) / 4503599627370496.0)"


@query("f15_augmentation_plan", "media", f"SELECT media_id, CASE WHEN {UNIT.format(chr(39) + '7:1:' + chr(39) + ' || media_id')} < 0.5 THEN 'blur' ELSE 'noise' END AS op, round({UNIT.format(chr(39) + '7:2:' + chr(39) + ' || media_id')} * 3, 8) AS strength FROM media")
def _(get):
    u = lambda k: S.unit_hash(F.concat(F.lit(f"7:{k}:"), F.col("media_id").cast("string")))
    return get("media").select("media_id", F.when(u(1) < 0.5, "blur").otherwise("noise").alias("op"), (u(2) * 3).alias("strength"))


@query("f14_settings_tag", "media", "SELECT media_id, sha256('{\"ext\":\"' || ext || '\",\"height\":' || height || ',\"width\":' || width || '}') AS tag FROM media")
def _(get):
    return get("media").select("media_id", F.sha2(F.to_json(F.struct("ext", "height", "width")), 256).alias("tag"))


@query("m21_threshold_sweep", "scored", """, t AS (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.3, 0.5]) AS pct, unnest(quantile_cont(abs(logit), [0.0, 0.05, 0.1, 0.2, 0.3, 0.5])) AS cut FROM scored)
SELECT CAST(pct AS DOUBLE) AS pct, round(cut, 8) AS cut, round(avg((abs(logit) >= cut)::INT), 8) AS coverage, round(avg(((logit >= 0) = (y = 1))::INT) FILTER (abs(logit) >= cut), 8) AS accuracy, avg((abs(logit) >= cut)::INT) >= 0.75 AS passes FROM scored, t GROUP BY pct, cut""")
def _(get):
    s = get("scored").withColumn("conf", F.abs("logit"))
    pcts = [0.0, 0.05, 0.1, 0.2, 0.3, 0.5]
    cuts = percentiles(s, "conf", {f"c{i}": q for i, q in enumerate(pcts)}).select(F.array(*[f"c{i}" for i in range(len(pcts))]).alias("cuts"))
    table = cuts.select(F.explode(F.arrays_zip(F.array(*map(F.lit, pcts)).alias("pct"), F.col("cuts").alias("cut"))).alias("c")).select("c.pct", "c.cut")
    kept = F.col("conf") >= F.col("cut")
    right = ((F.col("logit") >= 0).cast("int") == F.col("y")).cast("double")
    out = s.crossJoin(F.broadcast(table)).groupBy("pct", "cut").agg(F.avg(kept.cast("double")).alias("coverage"), F.avg(F.when(kept, right)).alias("accuracy"))  # six candidates
    return out.withColumn("passes", F.col("coverage") >= 0.75)
