import random

from pyspark.sql import functions as F

from veraframe.operators.tracking import LANDMARKS
from veraframe.plans.stream_queries import closing, drained, streamed
from veraframe.streaming import jobs


def test_shuffled_frames_are_tracked_as_in_order(spark):
    rng = random.Random(1)
    rows = [(v, f, v * 100 + f * 3 + i, 0.9, 50.0 * i + rng.random() * 9, 5.0, 30.0, 30.0, *[1.0] * 10) for v in (1, 2, 3) for f in range(8) for i in range(3)]
    rng.shuffle(rows)
    faces = spark.createDataFrame(rows, "video_id long, frame_index int, det_key long, confidence double, x double, y double, w double, h double, " + ", ".join(f"{c} double" for c in LANDMARKS))
    timed = faces.withColumn("ts", F.timestamp_seconds(F.col("frame_index") + 1000))
    got = drained(jobs.ordered_tracks(closing(timed, "video_id", "faces"))).filter("video_id <> -1")
    want = drained(jobs.online_tracks(streamed(faces, "faces")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == len(rows)
