"""Face linking, tracking and slot resolution against brute force."""

import collections
import math
import random

import pytest

from veraframe.operators import tracking as T

SCHEMA = "video_id long, frame_index int, det_key long, confidence double, x double, y double, w double, h double, " + ", ".join(f"{c} double" for c in T.LANDMARKS)


def face(video, frame, key, x, y=0.0, w=20.0, h=20.0, conf=0.9, marks=None):
    return (video, frame, key, conf, float(x), float(y), float(w), float(h), *(marks or [float(x)] * 10))


def overlap(a, b):
    (ax, ay, aw, ah), (bx, by, bw, bh) = a[4:8], b[4:8]
    i = max(0, min(ax + aw, bx + bw) - max(ax, bx)) * max(0, min(ay + ah, by + bh) - max(ay, by))
    return i / (aw * ah + bw * bh - i)


def score(a, b):
    if overlap(a, b) >= 0.3:
        return 1 + overlap(a, b)
    (ax, ay, aw, ah), (bx, by, bw, bh) = a[4:8], b[4:8]
    shift = math.dist((ax + aw / 2, ay + ah / 2), (bx + bw / 2, by + bh / 2)) / ((aw + bw) / 2)
    sizes = sorted((aw * ah, bw * bh))
    return 1 - shift + 1e-6 if shift <= 1 and sizes[1] / sizes[0] <= 2.25 else 0


def by_frame(rows):
    frames = collections.defaultdict(list)
    for r in sorted(rows):
        frames[r[1]].append(r)
    return sorted(frames.items())


def brute_links(rows):
    tracks = []
    for _, dets in by_frame(rows):
        free, before = list(range(len(dets))), list(range(len(tracks)))
        while best := max(((score(tracks[t][-1], dets[i]), -t, -i) for t in before for i in free), default=None):
            if best[0] <= 0:
                break
            tracks[-best[1]].append(dets[-best[2]])
            before.remove(-best[1])
            free.remove(-best[2])
        tracks += [[dets[i]] for i in free]
    return {r[2]: t for t, track in enumerate(tracks) for r in track}


def brute_tracker(rows, gap):
    live, done = [], []
    for at, dets in by_frame(rows):
        done += [t for t in live if at - t[-1][1] > gap]
        live = [t for t in live if at - t[-1][1] <= gap]
        free = list(range(len(dets)))
        for t in live:
            marks = lambda d, t=t: sum(math.dist(d[j : j + 2], t[-1][j : j + 2]) for j in range(8, 18, 2))
            fit = [(overlap(t[-1], dets[i]) - 0.001 * marks(dets[i]), -i) for i in free if overlap(t[-1], dets[i]) >= 0.3]
            if fit:
                t.append(dets[-max(fit)[1]])
                free.remove(-max(fit)[1])
        live += [[dets[i]] for i in free]
    ordered = sorted(done + live, key=lambda t: t[0][1])
    return {r[2]: n for n, t in enumerate(ordered) for r in t}


@pytest.fixture(scope="module")
def random_faces(spark):
    rng = random.Random(8)
    rows, key = [], 0
    for video in range(6):
        for lane in range(rng.randint(1, 5)):
            x = lane * 18.0
            for frame in range(0, 24, rng.choice([1, 2])):
                x += rng.uniform(-6, 6)
                if rng.random() < 0.75:
                    rows.append(face(video, frame, key, x, rng.uniform(0, 5), rng.uniform(15, 25), 20, rng.random(), [rng.uniform(0, 30) for _ in range(10)]))
                    key += 1
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_links(random_faces):
    rows, df = random_faces
    got = {r.det_key: r.track for r in T.link_tracks(df).collect()}
    want = {}
    for v in {r[0] for r in rows}:
        want |= brute_links([r for r in rows if r[0] == v])
    assert got == want


def test_tracker(random_faces):
    rows, df = random_faces
    for gap in (1, 3):
        got = {r.det_key: r.track for r in T.track_faces(df, max_gap=gap).collect()}
        want = {}
        for v in {r[0] for r in rows}:
            want |= brute_tracker([r for r in rows if r[0] == v], gap)
        assert got == want


def test_links_of_sparse_and_drifting_faces(spark):
    still = [face(1, f, f, 0) for f in (0, 2, 4)]
    drift = [face(2, f, 10 + f, 15 * f) for f in range(4)]  # three quarters of a width from frame to frame
    got = {r.det_key: r.track for r in T.link_tracks(spark.createDataFrame(still + drift, SCHEMA)).collect()}
    assert set(got.values()) == {0}
    tracked = T.link_tracks(spark.createDataFrame([*drift, face(2, 1, 99, 300)], SCHEMA))
    assert T.primary_tracks(tracked).first().frames == 4
    report = T.track_report(T.track_faces(spark.createDataFrame([*[face(1, f, f, 0) for f in range(6)], *[face(1, f, 50 + f, 100) for f in range(2)], face(1, 5, 90, 200)], SCHEMA))).first()
    assert (report.tracks, report.track, report.length, report.others, report.warning) == (3, 1, 6, 1, "multiple_face_tracks")  # of two that start together, the one that closed first has number 0


def test_face_at(spark):
    rows = [face(1, 0, 1, 0), face(1, 2, 2, 2), face(1, 5, 3, 3), face(1, 6, 4, 200), face(1, 6, 5, 190), face(1, 8, 6, 14)]
    df = spark.createDataFrame(rows, SCHEMA)
    tracked = T.link_tracks(df).filter("det_key <> 6").unionByName(T.link_tracks(df).filter("det_key = 6").selectExpr("video_id", "frame_index", "det_key", "confidence", "9 AS track"))
    wanted = spark.createDataFrame([(1, a) for a in (2, 6, 8, 4)], "video_id long, at int")
    got = {r.at: (r.nearest, r.det_key) for r in T.face_at(wanted, df, tracked).collect()}
    assert got == {2: (2, 2), 6: (5, None), 8: (5, 6), 4: (5, None)}


def test_slots(spark):
    assert T.recovery_offsets([0, 5, 10], 1, 12, 3) == [1, -1, 2, -2]
    assert T.recovery_offsets([1, 3, 9], 0, 12, 2) == [-1] and T.recovery_offsets([1, 3, 9], 2, 12, 3) == [1, -1, 2, -2]
    valid = {
        1: {"a": [0, 5, 10], "b": [0, 5, 10]},  # planned throughout
        2: {"a": [4, 6], "b": [4, 6]},  # joint, +1 before -1
        3: {"a": [5], "b": [7]},  # individual
        4: {"a": [5], "b": []},  # one member has nothing
    }
    rows = [(v, m, f) for v, members in valid.items() for m, frames in members.items() for f in frames or [None]]
    out = T.resolve_slots(spark.createDataFrame(rows, "video_id long, member string, frame_index int"), [0, 5, 10], 12, 3)
    got = {(r.video_id, r.slot): (r.mode, [f.frame for f in r.frames]) for r in out.collect()}
    assert [got[1, s] for s in range(3)] == [("planned", [0, 0]), ("planned", [5, 5]), ("planned", [10, 10])]
    assert got[2, 1] == ("joint", [6, 6]) and got[3, 1] == ("individual", [5, 7]) and got[4, 1] == ("failed", [5, None])
    assert got[2, 0] == ("failed", [None, None])
