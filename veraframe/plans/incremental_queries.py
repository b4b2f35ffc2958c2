"""Queries of what goes on from run to run: windows that close, scores of new rows and the score cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veraframe.functions.scalars import sigmoid
from veraframe.functions import table_functions as TF
from veraframe.functions.scoring import score_frames
from veraframe.operators import score_counts as CN
from veraframe.plans.media_queries import linear_scorer
from veraframe.plans.registry import registry
from veraframe.plans.score_queries import BIN, P, with_p
from veraframe.sources import media_files as MF
from veraframe.sources import score_cache as SC
from veraframe.sources.shared import new_path
from veraframe.streaming import monitoring as MO

QUERIES, ORACLES, query = registry()

#: The log comes in four turns: three of ten days each, with one row in 50 a turn late, which the watermark has mostly passed.
TURN = "least(2, CAST(floor((extract(DAY FROM ts) - 1) / 10) AS INT)) + CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END"

CLOSED = f""", a AS (SELECT *, {TURN} AS turn FROM log),
m AS (SELECT turn, max(ts) - INTERVAL 10 MINUTE AS top FROM a GROUP BY 1),
passed AS (SELECT turn, max(top) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(top) OVER () AS after FROM m),
r AS (SELECT a.*, date_trunc('hour', ts) AS hour, after FROM a JOIN passed USING (turn) WHERE before IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > before),
w AS (SELECT hour, verdict, after, count(*) AS n, sum(total_ms) AS sum_ms, max(total_ms) AS max_ms FROM r WHERE hour + INTERVAL 1 HOUR <= after GROUP BY 1, 2, 3)
"""


def _log_in_turns(get, job) -> DataFrame:
    log = get("log").withColumn("turn", F.expr(TURN))
    return MO.appended(log.sparkSession, job, log, "turn")[0]


@query("t2_closed_windows", "log", CLOSED + "SELECT CAST(epoch(hour) AS BIGINT) AS start_s, verdict, n, round(sum_ms, 8) AS sum_ms, max_ms FROM w")
def _(get):
    return _log_in_turns(get, MO.closed_windows).select(F.unix_timestamp("start").alias("start_s"), "verdict", "n", "sum_ms", "max_ms")


@query("t2_daily_rollup", "log", CLOSED + "SELECT CAST(epoch(date_trunc('day', hour)) AS BIGINT) AS start_s, CAST(sum(n) AS BIGINT) AS n, count(*) AS windows, round(sum(sum_ms), 8) AS sum_ms, max(max_ms) AS max_ms FROM w WHERE date_trunc('day', hour) + INTERVAL 1 DAY <= after GROUP BY 1")
def _(get):
    return _log_in_turns(get, lambda log: MO.rolled_up(MO.closed_windows(log))).select(F.unix_timestamp("start").alias("start_s"), "n", "windows", "sum_ms", "max_ms")


LINEAR = "round(list_sum(list_transform(embedding, lambda v, i: CAST(v AS DOUBLE) * CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END)), 6)"


@query("t4_scores_within", "thumbs", f"SELECT vec_id, {LINEAR} AS logit, CAST(1 AS BIGINT) AS times FROM thumbs")
def _(get):
    """The second turn brings all rows, of which half were there before."""
    t = get("thumbs").select("vec_id", "embedding", F.timestamp_seconds(F.col("vec_id") % 3600 + 1_000_000).alias("ts"))
    rows = t.filter("vec_id % 2 = 0").withColumn("turn", F.lit(0)).unionByName(t.withColumn("turn", F.lit(1)))
    out = new_path(t.sparkSession, "scores")
    MO.in_turns(rows, "turn", lambda s: MO.scores_within(s, lambda df: score_frames(df, "embedding", linear_scorer, ["vec_id"]), ["vec_id"], out, f"{out}-state"))
    return MO.first_scores(t.sparkSession, out, ["vec_id"]).select("vec_id", F.round("logit", 6).alias("logit"), "times")


@query("s12_sharded_cache", "thumbs", f"SELECT vec_id, {LINEAR} AS logit FROM thumbs ORDER BY vec_id")
def _(get):
    """A run that died before its commit is done again; the one after it has nothing to do."""
    t = get("thumbs").withColumn("sha256", F.sha2(F.to_json(F.struct("embedding")), 256))
    path = new_path(t.sparkSession, "score-cache")
    score = lambda df: score_frames(df, "embedding", linear_scorer, ["vec_id", "sha256"])
    SC.write_shards(t.filter("label < 5"), ["vec_id"], "sha256", path, "linear-1", score)
    for _ in range(2):
        SC.fill(t, ["vec_id"], "sha256", path, "linear-1", "v1", score)
    return SC.consolidated(t, ["vec_id"], "sha256", ["vec_id"], path, "linear-1", "v1").select("vec_id", F.round("logit", 6).alias("logit"))


#: A file for each part, by its key modulo 12: three formats of pictures and videos, and every fault. Lengths of videos are those of the part's size.
FILES = """SELECT p_partkey AS media_id, p_size, CONCAT(CASE WHEN p_partkey % 24 < 12 THEN 'a/' ELSE 'b/c/' END, CAST(p_partkey AS STRING),
  CASE WHEN p_partkey % 12 IN (0, 3, 9) THEN '.JPG' WHEN p_partkey % 12 IN (1, 6) THEN '.png' WHEN p_partkey % 12 = 4 THEN '.txt' WHEN p_partkey % 12 = 10 THEN '.webm' WHEN p_partkey % 12 = 11 THEN '.avi' ELSE '.mp4' END) AS path,
  unhex(CASE WHEN p_partkey % 12 IN (0, 4) THEN 'FFD8FFE0' WHEN p_partkey % 12 = 1 THEN '89504E470D0A1A0A' WHEN p_partkey % 12 = 3 THEN '' WHEN p_partkey % 12 = 5 THEN '00010203'
    WHEN p_partkey % 12 = 8 THEN '000000106674797069736F6D00000000' WHEN p_partkey % 12 = 9 THEN CONCAT('FFD8FF', repeat('00', 1000))
    WHEN p_partkey % 12 = 10 THEN '1A45DFA3801853806701FFFFFFFFFFFFFF1549A9668E2AD7B1830F4240448984459C4000'
    WHEN p_partkey % 12 = 11 THEN CONCAT('5249464600000000415649204C495354000000006864726C6176696838000000409C0000', repeat('00', 12), lpad(hex(p_size), 2, '0'), '000000')
    ELSE CONCAT('000000106674797069736F6D00000000000000246D6F6F760000001C6D766864', repeat('00', 12), '000003E8', lpad(hex(p_size * 800), 8, '0')) END) AS content
FROM parquet.`{at}/part.parquet`"""


def s9_media_files(spark, sf_dir: str) -> DataFrame:
    made, root = spark.sql(FILES.format(at=sf_dir)), new_path(spark, "media")
    MF.write_files(made.filter("media_id % 12 <> 7").repartition("path"), "path", "content", root)
    folder = spark.createDataFrame([(-1, "b/c")], "media_id long, path string")
    expected = made.select(F.col("media_id").cast("long").alias("media_id"), "path").unionByName(folder)
    got = MF.validated(expected, "path", MF.media_files_at(expected, "path", root), root, MF.Limits(image_bytes=1000, seconds=30.0))
    return got.select("media_id", "media_type", "size_bytes", F.round("duration_s", 6).alias("duration_s"), F.array_join("codes", ",").alias("codes"))


QUERIES["s9_media_files"] = s9_media_files
ORACLES["s9_media_files"] = """WITH k AS (SELECT CAST(p_partkey AS BIGINT) AS media_id, p_partkey % 12 AS k, p_size FROM part),
c AS (SELECT *, CASE WHEN k = 3 THEN 'empty_file' WHEN k = 4 THEN 'unsupported_extension' WHEN k = 5 THEN 'signature_unrecognized' WHEN k = 6 THEN 'signature_extension_mismatch' WHEN k = 7 THEN 'file_not_found'
  WHEN k = 8 THEN 'video_unreadable' WHEN k = 9 THEN 'file_too_large' WHEN k = 2 AND p_size * 0.8 > 30 THEN 'video_too_long' ELSE '' END AS codes FROM k)
SELECT media_id, CASE WHEN codes <> '' THEN NULL WHEN k < 2 THEN 'image' ELSE 'video' END AS media_type,
  CAST(CASE k WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 3 THEN 0 WHEN 4 THEN 4 WHEN 5 THEN 4 WHEN 7 THEN 0 WHEN 8 THEN 16 WHEN 9 THEN 1003 WHEN 10 THEN 36 WHEN 11 THEN 52 ELSE 52 END AS BIGINT) AS size_bytes,
  CAST(CASE k WHEN 2 THEN round(p_size * 0.8, 6) WHEN 10 THEN 5.0 WHEN 11 THEN round(p_size * 0.04, 6) END AS DOUBLE) AS duration_s, codes FROM c
UNION ALL SELECT -1, NULL, 0, NULL, 'not_a_file'"""


def _counts(df: DataFrame, score: str) -> DataFrame:
    """Counts of two halves of the rows, merged."""
    half = F.col("row_key") % 2 == 0
    return CN.merged(CN.score_counts(df.filter(half), ["method"], "y", score), CN.score_counts(df.filter(~half), ["method"], "y", score))


@query("x6_grouped_ap", "scored", """, d AS (SELECT method, logit, sum(y) AS pos, count(*) AS n FROM scored GROUP BY 1, 2), s AS (SELECT *, sum(pos) OVER w AS hits, sum(n) OVER w AS seen FROM d WINDOW w AS (PARTITION BY method ORDER BY logit DESC))
SELECT method, round(sum(pos * hits / seen) / NULLIF(sum(pos), 0), 8) AS ap FROM s GROUP BY 1""")
def _(get):
    return CN.average_precision_of(_counts(get("scored"), "logit"), ["method"])


@query("x6_grouped_ece", "scored", f", q AS (SELECT method, y, {P} AS p FROM scored), b AS (SELECT method, {BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM q GROUP BY 1, 2) SELECT method, round(sum(n * abs(mp - my)) / sum(n), 8) AS ece FROM b GROUP BY 1")
def _(get):
    return CN.calibration_error_of(_counts(get("scored"), "logit"), ["method"], sigmoid("score"))


@query("x6_grouped_conformal", "scored", f""", s AS (SELECT method, {P} AS s FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY s) AS k, count(*) OVER (PARTITION BY method) AS n FROM s)
SELECT method, n, round(coalesce(min(CASE WHEN k >= ceil((n + 1) * CAST(0.9 AS DOUBLE)) THEN s END), 1.0), 8) AS q FROM r GROUP BY method, n""")
def _(get):
    return CN.conformal_quantile_of(_counts(with_p(get("scored")), "p"), ["method"], 0.1)


@query("x4_lateral_detections", "thumbs", ", e AS (SELECT vec_id, CAST(unnest(range(64)) AS INT) AS det, CAST(unnest(embedding) AS DOUBLE) AS confidence FROM thumbs) SELECT vec_id, det, round(confidence, 8) AS confidence FROM e WHERE confidence > 0.2")
def _(get):
    t = get("thumbs")
    TF.register_detector(t.sparkSession, "found_in", lambda v: ((i, x) for i, x in enumerate(v) if x > 0.2))
    return t.sparkSession.sql("SELECT t.vec_id, d.det, d.confidence FROM {t} t, LATERAL found_in(t.embedding) d", t=t)


@query("x4_run_table_function", "log", """, s AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour FROM log), g AS (SELECT *, CASE WHEN hour - lag(hour) OVER w <= 24 THEN 0 ELSE 1 END AS opens FROM s WINDOW w AS (PARTITION BY user_id ORDER BY hour)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY hour ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(hour) AS "first", max(hour) AS "last", count(*) AS n FROM r GROUP BY user_id, run""")
def _(get):
    log = get("log").select("user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("hour"))
    TF.register_runs(log.sparkSession, "runs_of_hours", "user_id", "hour", 24)
    return log.sparkSession.sql("SELECT * FROM runs_of_hours(TABLE(SELECT * FROM {log}))", log=log)
