"""Streaming operators, run over the tables as bounded streams or in their batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veraframe.operators.tracking import LANDMARKS
from veraframe.plans.fixtures import duck, view
from veraframe.plans.manifest_queries import PARSED
from veraframe.plans.registry import rounded
from veraframe.plans.score_queries import DECIDE_SQL, STAGES
from veraframe.sources.shared import materialise, new_path
from veraframe.streaming import jobs

QUERIES: dict = {}
ORACLES: dict = {}


def streamed(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a stream of files."""
    written = materialise(df, name)
    return df.sparkSession.readStream.schema(df.schema).parquet(written.inputFiles()[0].rsplit("/", 1)[0])


def drained(df: DataFrame) -> DataFrame:
    """All that a stream emits over what is there now, as a table in the shared folder."""
    spark, out = df.sparkSession, new_path(df.sparkSession, "stream")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def drained_whole(df: DataFrame) -> DataFrame:
    """The whole result of an aggregating stream over what is there now, windows that are still open included."""
    spark, out = df.sparkSession, new_path(df.sparkSession, "stream")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def t1_early_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = view(spark, sf_dir, "frames").select("sample_id", "slot", "logit")
    return drained(jobs.early_decisions(streamed(frames, "frames"), STAGES)).select("sample_id", "verdict", "frames_used")


def t2_verdict_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = streamed(view(spark, sf_dir, "log"), "log")
    return rounded(drained_whole(jobs.verdict_monitor(log)).select(F.unix_timestamp("start").alias("start_s"), "verdict", "n", "mean_ms"))


def t2_sliding_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = streamed(view(spark, sf_dir, "log"), "log")
    return rounded(drained_whole(jobs.verdict_monitor(log, window="2 hours", slide="1 hour")).select(F.unix_timestamp("start").alias("start_s"), "verdict", "n", "mean_ms"))


def t2_user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained_whole(jobs.user_sessions(streamed(view(spark, sf_dir, "log"), "log"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


def t3_online_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = view(spark, sf_dir, "faces")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return drained(jobs.online_tracks(streamed(faces.select("video_id", "frame_index", "det_key", "confidence", "x", "y", "w", "h", *LANDMARKS), "faces")))


def closing(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` as a stream, with a row a day later (and -1 in ``key``) that lets the watermark pass all others."""
    last = df.agg(*[(F.max(c) + F.expr("INTERVAL 1 DAY") if c == "ts" else F.lit(-1).cast(t) if c == key else F.max(c)).alias(c) for c, t in df.dtypes])
    return streamed(df.unionByName(last), name)


def t3_ordered_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames are a second apart; a frame is linked when the watermark has passed it."""
    faces = view(spark, sf_dir, "faces").select("video_id", "frame_index", "det_key", "confidence", "x", "y", "w", "h", *LANDMARKS, F.timestamp_seconds(F.col("frame_index") + 1_000_000).alias("ts"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return drained(jobs.ordered_tracks(closing(faces, "video_id", "faces"))).filter("video_id <> -1")


def t1_timed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every video is decided, those short of frames when the watermark passes their end."""
    frames = view(spark, sf_dir, "frames").select("sample_id", "slot", "logit", F.timestamp_seconds(F.col("slot") + 1_000_000).alias("ts"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return drained(jobs.timed_decisions(closing(frames, "sample_id", "frames"), STAGES)).filter("sample_id <> '-1'")


def t4_incremental_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veraframe.functions.scoring import score_frames
    from veraframe.plans.media_queries import linear_scorer

    out = new_path(spark, "scores")
    jobs.incremental_scores(streamed(view(spark, sf_dir, "thumbs"), "thumbs"), lambda df: score_frames(df, "embedding", linear_scorer, ["vec_id"]), ["vec_id"], out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).select("vec_id", F.round("logit", 6).alias("logit"))


def t5_run_log_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "run-log")
    log = view(spark, sf_dir, "log").select("event_id", "total_ms", "verdict")
    jobs.run_log_tables(streamed(log, "log"), out, f"{out}-state", "verdict").awaitTermination()
    return spark.read.parquet(out).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total_ms"), 6).alias("total_ms"))


def t6_manifest_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = new_path(spark, "samples"), new_path(spark, "issues")
    lines = view(spark, sf_dir, "raw_lines").select("value")
    jobs.manifest_intake(streamed(lines, "lines"), good, bad, f"{good}-state").awaitTermination()
    return spark.read.parquet(bad).groupBy("issue").agg(F.count(F.lit(1)).alias("n")).unionByName(spark.read.parquet(good).agg(F.lit("ok").alias("issue"), F.count(F.lit(1)).alias("n")))


for f in (t1_early_decisions, t1_timed_decisions, t2_verdict_monitor, t2_sliding_monitor, t2_user_sessions, t3_online_tracks, t3_ordered_tracks, t4_incremental_scores, t5_run_log_tables, t6_manifest_intake):
    QUERIES[f.__name__] = f

ORACLES["t1_early_decisions"] = duck("frames", DECIDE_SQL + "SELECT sample_id, verdict, frames_used FROM decisions WHERE reason NOT LIKE 'insufficient%'")
ORACLES["t1_timed_decisions"] = duck("frames", DECIDE_SQL + "SELECT sample_id, verdict, reason, frames_used FROM decisions")
ORACLES["t2_verdict_monitor"] = duck("log", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, verdict, count(*) AS n, round(avg(total_ms), 8) AS mean_ms FROM log GROUP BY 1, 2")
ORACLES["t2_sliding_monitor"] = duck("log", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) - back * 3600 AS start_s, verdict, count(*) AS n, round(avg(total_ms), 8) AS mean_ms FROM log, (VALUES (0), (1)) b(back) GROUP BY 1, 2")
ORACLES["t2_user_sessions"] = duck("log", ", g AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM log) SELECT user_id, CAST(sum(opens) AS BIGINT) AS sessions, count(*) AS events FROM g GROUP BY 1")
ORACLES["t5_run_log_tables"] = duck("log", "SELECT verdict, count(*) AS n, round(sum(total_ms), 6) AS total_ms FROM log GROUP BY 1")
ORACLES["t4_incremental_scores"] = duck("thumbs", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v, i: CAST(v AS DOUBLE) * CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END)), 6) AS logit FROM thumbs")

ORACLES["t6_manifest_intake"] = duck("raw_lines", PARSED + "SELECT coalesce(issue, 'ok') AS issue, count(*) AS n FROM p GROUP BY 1")
