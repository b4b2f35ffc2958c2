"""Trackers that get videos by the bucket: keys that are null or large, ties, and what goes on from batch to batch."""

import random

from veraframe.operators.tracking import LANDMARKS
from veraframe.plans.stream_queries import drained, streamed
from veraframe.sources.shared import new_path
from veraframe.streaming import jobs

SCHEMA = "video_id long, frame_index int, det_key long, confidence double, x double, y double, w double, h double, " + ", ".join(f"{c} double" for c in LANDMARKS)


def face(video, frame, key, x):
    return (video, frame, key, 0.9, float(x), 5.0, 30.0, 30.0, *[1.0] * 10)


def test_videos_of_a_bucket_stay_apart(spark):
    videos = [1, None, (1 << 60) + 1, (1 << 60) + 2]
    rows = [face(v, f, n * 100 + f * 2 + i, 50 * i + f) for n, v in enumerate(videos) for f in range(4) for i in range(2)]
    faces = spark.createDataFrame([*rows, face(1, None, 99, 0)], SCHEMA).coalesce(1)
    for buckets in (1, 64):
        got = drained(jobs.online_tracks(streamed(faces, "faces"), buckets=buckets)).collect()
        assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([(r[0], r[1], r[2], r[2] % 2 if r[1] is not None else None) for r in [*rows, face(1, None, 99, 0)]], "video_id long, frame_index int, det_key long, track int").collect()))


def test_equal_keys_are_linked_in_the_order_of_their_boxes(spark):
    rows = [face(1, f, 7, 50 * i + f) for f in range(5) for i in range(4)]
    random.Random(3).shuffle(rows)
    found = []
    for turn in (rows, rows[::-1]):
        got = drained(jobs.online_tracks(streamed(spark.createDataFrame(turn, SCHEMA).coalesce(1), "faces")))
        found.append(sorted(map(tuple, got.collect())))
    assert found[0] == found[1] == sorted((1, f, 7, i) for f in range(5) for i in range(4))


def test_tracks_go_on_in_later_batches(spark):
    path = new_path(spark, "turns")
    turns = [[face(v, f, v * 100 + f * 2 + i, 50 * i + f) for v in range(9) for f in fs for i in range(2)] for fs in ((0, 1), (2, 1), (3, 7))]
    for rows in turns:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    got = sorted(map(tuple, drained(jobs.online_tracks(stream, buckets=2)).collect()), key=str)
    track = lambda f, i: i if f < 7 else 2 + i  # noqa: E731 - after a gap of three frames come new tracks
    want = [(r[0], r[1], r[2], None if t == 1 and r[1] == 1 else track(r[1], r[2] % 2)) for t, rows in enumerate(turns) for r in rows]
    assert got == sorted(want, key=str)
