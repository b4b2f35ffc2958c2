"""The buffered tracker by the bucket: input of many tasks, ends of videos and tracks that wait for the watermark."""

import random

from pyspark.sql import functions as F

from tests.test_tracker_buckets import SCHEMA, face
from veraframe.plans import stream_queries
from veraframe.plans.stream_queries import closing, drained, streamed
from veraframe.sources.shared import new_path
from veraframe.streaming import jobs


def test_closing_is_written_by_many_tasks(spark, monkeypatch):
    rows = [face(v, f, v * 1000 + f * 10 + i, 50 * i + f % 3) for v in range(40) for f in range(6) for i in range(3)]
    random.Random(2).shuffle(rows)
    timed = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("ts", F.timestamp_seconds(F.col("frame_index") + 1000))
    parts, write = [], stream_queries.materialise
    monkeypatch.setattr(stream_queries, "materialise", lambda df, name: parts.append(df.rdd.getNumPartitions()) or write(df, name))
    stream = closing(timed, "video_id", "faces")
    got = drained(jobs.ordered_tracks(stream, buckets=3)).filter("video_id <> -1")
    want = drained(jobs.online_tracks(streamed(timed.drop("ts"), "faces")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == len(rows)
    assert parts[0] >= 5


def test_videos_end_and_open_tracks_wait(spark):
    """Three batches by time: a video that comes back after its end has new tracks, one that goes on keeps its own."""
    path = new_path(spark, "turns")
    at = [{1: [0, 1], 2: [0, 1]}, {1: [2, 3], 3: [9]}, {2: [500], 3: [510]}]
    rows = [[(*face(v, f, v * 10000 + f, f % 5), f) for v, fs in turn.items() for f in fs] for turn in at]
    for turn in [*rows, [(*face(-1, 90000, 1, 0), 90000)]]:
        spark.createDataFrame(turn, SCHEMA + ", s int").withColumn("ts", F.timestamp_seconds(F.col("s") + 1000)).drop("s").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r.video_id, r.frame_index): r.track for r in drained(jobs.ordered_tracks(stream, max_gap=1000, buckets=1)).collect() if r.video_id > 0}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 0, (2, 0): 0, (2, 1): 0, (3, 9): 0, (2, 500): 0, (3, 510): 0}
