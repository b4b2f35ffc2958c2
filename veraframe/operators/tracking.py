"""Face detections: linking over frames, primary tracks, as-of lookup and slot resolution.

Linking is sequential within a video: it is one pass over the video's detections in the order of frames, with the last
boxes of its open tracks as its state. Everything else is declarative.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veraframe.functions.scalars import iou
from veraframe.sources.shared import materialise


#: The places of left, top, width and height in the rows of a pass; the ten landmark coordinates follow.
BOX = 4
LANDMARKS = [f"l{c}{i}" for i in range(1, 6) for c in "xy"]
#: What a pixel of landmark distance takes off a tracker's score: enough to break near ties of overlap.
LANDMARK_WEIGHT = 0.001


def _iou(a: tuple, b: tuple) -> float:
    (ax, ay, aw, ah), (bx, by, bw, bh) = a[BOX : BOX + 4], b[BOX : BOX + 4]
    ar, br, ab, bb = ax + aw, bx + bw, ay + ah, by + bh
    wide = (br if br < ar else ar) - (bx if bx > ax else ax)
    high = (bb if bb < ab else ab) - (by if by > ay else ay)
    wide, high = (wide if wide > 0.0 else 0.0), (high if high > 0.0 else 0.0)
    union = aw * ah + bw * bh - wide * high
    return wide * high / union if union > 0 else 0.0


def _link(a: tuple, b: tuple, iou_min: float, shift: float, ratio: float) -> float:
    """How well two boxes some frames apart are one face, 0 if they are not; see :func:`link_score`."""
    overlap = _iou(a, b)
    if overlap >= iou_min:
        return 1.0 + overlap
    (ax, ay, aw, ah), (bx, by, bw, bh) = a[BOX : BOX + 4], b[BOX : BOX + 4]
    width = (aw + bw) / 2
    if width <= 0:
        return 0.0
    apart = math.hypot(ax + aw / 2 - bx - bw / 2, ay + ah / 2 - by - bh / 2) / width
    sizes = max(aw * ah, bw * bh) / max(1e-9, min(aw * ah, bw * bh))
    return 1.0 - apart / (shift + 1e-9) + 1e-6 if apart <= shift and sizes <= ratio**2 else 0.0


def link_score(a: list[Column], b: list[Column], iou_min: float = 0.3, shift: float = 1.0, ratio: float = 1.5) -> Column:
    """1 + overlap where boxes overlap by ``iou_min``; else, with centres at most ``shift`` mean widths apart and areas that
    differ by at most ``ratio`` squared, what is left of the shift (under 1); else 0. Boxes are left, top, width, height.
    """
    overlap = iou(*a, *b)
    width = (a[2] + b[2]) / 2
    apart = F.hypot(a[0] + a[2] / 2 - b[0] - b[2] / 2, a[1] + a[3] / 2 - b[1] - b[3] / 2) / width
    sizes = F.greatest(a[2] * a[3], b[2] * b[3]) / F.greatest(F.lit(1e-9), F.least(a[2] * a[3], b[2] * b[3]))
    near = (width > 0) & (apart <= shift) & (sizes <= ratio**2)
    return F.when(overlap >= iou_min, 1 + overlap).when(near, 1 - apart / (shift + 1e-9) + 1e-6).otherwise(F.lit(0.0))


def landmark_distance(a: list[str], b: list[str]) -> Column:
    """The sum of the distances of corresponding landmarks, given as x1, y1, x2, y2, ..."""
    pairs = [F.hypot(F.col(a[i]) - F.col(b[i]), F.col(a[i + 1]) - F.col(b[i + 1])) for i in range(0, len(a), 2)]
    return reduce(lambda x, y: x + y, pairs)


def _by_frame(faces: DataFrame, video: str, frame: str, more: list[str], new_linker: Callable[[], Callable[[list[tuple]], list[int]]]) -> DataFrame:
    """(video, frame, det_key, confidence, track): a linker gives the rows of each frame their tracks' numbers.

    A video's rows come in the order of frames, so the work on it is one pass, with the linker's open tracks as its state.
    """
    kinds = dict(faces.dtypes)
    names = [video, frame, "det_key", "confidence", "track"]
    schema = f"`{video}` {kinds[video]}, `{frame}` {kinds[frame]}, det_key {kinds['det_key']}, confidence double, track int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        link, group = None, []
        linked = lambda rows: [(*row[:BOX], t) for row, t in zip(rows, link(rows), strict=True)]
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                if group and row[:2] != group[0][:2]:
                    out += linked(group)
                    link, group = (link if row[0] == group[0][0] else None), []
                link = link or new_linker()
                group.append(row)
            yield pd.DataFrame(out, columns=names)
        if group:
            yield pd.DataFrame(linked(group), columns=names)

    ordered = faces.select(video, frame, "det_key", "confidence", "x", "y", "w", "h", *more).repartition(video).sortWithinPartitions(video, frame, "det_key")
    return ordered.mapInPandas(run, schema)


def link_tracks(faces: DataFrame, video: str = "video_id", frame: str = "frame_index", iou_min: float = 0.3, shift: float = 1.0, ratio: float = 1.5) -> DataFrame:
    """``faces`` of sampled frames with ``track``: greedy one-to-one links, the best score first, then the older track.

    Samples lie far apart, so a face may go on with the last box of any track of its video, however long ago that was.
    """

    def new_linker():
        last: list[tuple] = []

        def link(rows: list[tuple]) -> list[int]:
            options = sorted((-score, t, i) for t, d in enumerate(last) for i, r in enumerate(rows) if (score := _link(d, r, iou_min, shift, ratio)) > 0)
            track: dict[int, int] = {}
            gone: set[int] = set()
            for _, t, i in options:
                if i not in track and t not in gone:
                    track[i] = t
                    gone.add(t)
            for i, r in enumerate(rows):
                t = track.setdefault(i, len(last))
                last[t : t + 1] = [r]
            return [track[i] for i in range(len(rows))]

        return link

    return _by_frame(faces, video, frame, [], new_linker)


class OpenTracks:
    """The open tracks of a video, by number, each with its last row; new tracks are numbered as they come.

    Rows are (video, frame, key, confidence, x, y, w, h, landmark coordinates), given frame by frame.
    """

    def __init__(self, iou_min: float, max_gap: int, last: dict[int, tuple] | None = None, count: int = 0) -> None:
        self.iou_min, self.max_gap, self.last, self.count = iou_min, max_gap, last or {}, count

    def link(self, rows: list[tuple]) -> list[int]:
        """The rows' tracks: each open track in turn takes the free row that overlaps it best."""
        track: dict[int, int] = {}
        for t, d in list(self.last.items()):
            if rows[0][1] - d[1] > self.max_gap:
                del self.last[t]
                continue
            best, found = -1.0, None
            for i, r in enumerate(rows):
                if i in track or (overlap := _iou(d, r)) < self.iou_min:
                    continue
                marks = [math.hypot(d[j] - r[j], d[j + 1] - r[j + 1]) for j in range(BOX + 4, len(r), 2)]
                score = overlap - LANDMARK_WEIGHT * sum(marks)
                if score > best:
                    best, found = score, i
            if found is not None:
                track[found], self.last[t] = t, rows[found]
        for i, r in enumerate(rows):
            if i not in track:
                track[i], self.last[self.count] = self.count, r
                self.count += 1
        return [track[i] for i in range(len(rows))]


def track_faces(faces: DataFrame, video: str = "video_id", frame: str = "frame_index", iou_min: float = 0.3, max_gap: int = 2) -> DataFrame:
    """``faces`` with ``track``: each open track in turn takes the free detection that overlaps its last box best.

    A detection needs an overlap of ``iou_min``; landmark distance breaks near ties. A track that has seen nothing for
    more than ``max_gap`` frames is closed. Tracks are numbered by their first frame, then by when they were closed.
    """

    tracked = materialise(_by_frame(faces, video, frame, LANDMARKS, lambda: OpenTracks(iou_min, max_gap).link), "tracked")
    ends = tracked.groupBy(video, "track").agg(F.min(frame).alias("start"), (F.max(frame) + max_gap).alias("pos"))
    frames = tracked.select(video, F.col(frame).alias("pos"), F.lit(None).cast("int").alias("track"), F.lit(None).cast(dict(tracked.dtypes)[frame]).alias("start"), F.col(frame).alias("seen")).distinct()
    later = Window.partitionBy(video).orderBy("pos", F.col("seen").isNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    closed = ends.withColumn("seen", F.lit(None).cast(dict(tracked.dtypes)[frame])).unionByName(frames).withColumn("closed", F.first("seen", ignorenulls=True).over(later))
    number = F.row_number().over(Window.partitionBy(video).orderBy("start", F.col("closed").asc_nulls_last(), "track")) - 1
    numbers = closed.filter("track IS NOT NULL").select(video, "track", number.alias("number"))
    return tracked.join(numbers, [video, "track"]).select(*[c for c in tracked.columns if c != "track"], F.col("number").alias("track"))


def track_report(tracked: DataFrame, video: str = "video_id") -> DataFrame:
    """(video, tracks, track, length, others, warning): the longest track, the first of equals, and whether others matter.

    Others do from a length of three tenths of the longest, but at least two faces.
    """
    sizes = tracked.groupBy(video, "track").agg(F.count(F.lit(1)).alias("length"))
    best = sizes.groupBy(video).agg(F.min(F.struct((-F.col("length")).alias("l"), "track")).alias("b"), F.count(F.lit(1)).alias("tracks"))
    best = best.select(video, "tracks", F.col("b.track").alias("primary"), (-F.col("b.l")).alias("longest"))
    least = F.greatest(F.lit(2), F.floor(F.col("longest") * 3 / 10))
    out = sizes.join(best, video).groupBy(video, "tracks", F.col("primary").alias("track"), F.col("longest").alias("length")).agg(F.count_if((F.col("track") != F.col("primary")) & (F.col("length") >= least)).alias("others"))
    return out.withColumn("warning", F.when(F.col("others") > 0, "multiple_face_tracks"))


def primary_tracks(tracked: DataFrame, video: str = "video_id", frame: str = "frame_index") -> DataFrame:
    """(video, track, frames, start): the longest track; ties by confidence, earlier start, smaller number."""
    sizes = tracked.groupBy(video, "track").agg(F.count(F.lit(1)).alias("frames"), F.avg("confidence").alias("conf"), F.min(frame).alias("start"))
    best = F.min(F.struct((-F.col("frames")).alias("f"), (-F.col("conf")).alias("c"), "start", "track")).alias("b")
    return sizes.groupBy(video).agg(best).select(video, F.col("b.track").alias("track"), (-F.col("b.f")).alias("frames"), F.col("b.start").alias("start"))


def nearest_frame(wanted: DataFrame, faces: DataFrame, video: str = "video_id", at: str = "at", frame: str = "frame_index") -> DataFrame:
    """``wanted`` (video, at) with the frame nearest to ``at`` among the video's detections, the lower one on ties.

    Two running windows over the union of both tables find the neighbours on either side, so a video with many frames is
    sorted, not multiplied out.
    """
    both = wanted.select(video, F.col(at).alias("pos"), F.lit(None).cast("long").alias("frame"), F.lit(1).alias("kind")).unionByName(
        faces.select(video, F.col(frame).alias("pos"), F.col(frame).cast("long").alias("frame"), F.lit(0).alias("kind"))
    )
    order = Window.partitionBy(video).orderBy("pos", "kind")
    sides = both.withColumns({
        "before": F.last("frame", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "after": F.first("frame", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    }).filter("kind = 1")
    nearer = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull() | (F.col("pos") - F.col("before") <= F.col("after") - F.col("pos")), F.col("before")).otherwise(F.col("after"))
    return sides.select(video, F.col("pos").alias(at), nearer.alias("nearest"))


def primary_face(faces: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the detection with the highest confidence, then area, then smallest key."""
    best = F.max(F.struct("confidence", (F.col("w") * F.col("h")).alias("area"), (-F.col("det_key")).alias("k"))).alias("b")
    return faces.groupBy(*keys).agg(best).select(*keys, (-F.col("b.k")).alias("det_key"), F.col("b.confidence").alias("confidence"), F.col("b.area").alias("area"))


def face_at(wanted: DataFrame, faces: DataFrame, tracked: DataFrame, video: str = "video_id", at: str = "at", frame: str = "frame_index") -> DataFrame:
    """``wanted`` (video, at) with ``nearest``, the primary track's nearest frame, and ``det_key``, the face at ``at``.

    That is the primary track's own, or else the detection there that links best to the track's face at ``nearest``, the
    first on ties; null if none links.
    """
    box = ["x", "y", "w", "h"]
    primary = tracked.join(primary_tracks(tracked, video, frame).select(video, "track"), [video, "track"], "left_semi").select(video, frame, "det_key")
    near = nearest_frame(wanted, primary, video, at, frame)
    track = primary.join(faces.select(video, frame, "det_key", *box), [video, frame, "det_key"])
    track = track.select(video, F.col(frame).alias("nearest"), F.col("det_key").alias("track_key"), *[F.col(c).alias(f"t{c}") for c in box])
    there = faces.select(video, F.col(frame).alias(at), "det_key", *box)
    met = near.join(track, [video, "nearest"], "left").join(there, [video, at], "left")
    score = F.when(F.col("det_key") == F.col("track_key"), F.lit(3.0)).otherwise(link_score([F.col(f"t{c}") for c in box], [F.col(c) for c in box]))
    best = F.min(F.when(score > 0, F.struct((-score).alias("s"), "det_key"))).alias("b")
    return met.groupBy(video, at, "nearest").agg(best).select(video, at, "nearest", F.col("b.det_key").alias("det_key"))


def recovery_offsets(planned: list[int], slot: int, count: int, reach: int) -> list[int]:
    """Offsets to try for a slot, +1, -1, +2, -2, ..., within ``reach``, the video and half of the gap to each neighbour."""
    here = planned[slot]
    left = (here - planned[slot - 1] - 1) // 2 if slot else here
    right = (planned[slot + 1] - here - 1) // 2 if slot + 1 < len(planned) else count - 1 - here
    return [sign * d for d in range(1, reach + 1) for sign, room in ((1, right), (-1, left)) if d <= room]


def resolve_slots(valid: DataFrame, planned: list[int], count: int, reach: int = 2, video: str = "video_id", frame: str = "frame_index", member: str = "member") -> DataFrame:
    """(video, slot, mode, frames) for a family of members that share a plan of ``count`` frames.

    ``valid`` has a row for every valid (video, member, frame), and a null frame for a member without any. The mode is
    ``planned`` if all members have the planned frame, ``joint`` if they share one at an offset, ``individual`` if every
    member has its own, else ``failed``. ``frames`` is an array of (member, frame), null for a member that failed.
    """
    spark = valid.sparkSession
    tries = [(s, r, p + d) for s, p in enumerate(planned) for r, d in enumerate([0, *recovery_offsets(planned, s, count, reach)])]
    plan = F.broadcast(spark.createDataFrame(tries, "slot int, rank int, f int"))  # a plan's few candidates
    seen = valid.select(video, member, F.col(frame).alias("f")).distinct()
    members = seen.select(video, member).distinct()
    slots = F.broadcast(spark.range(len(planned)).select(F.col("id").cast("int").alias("slot")))
    hits = seen.join(plan, "f").select(video, member, "slot", "rank", "f")
    sizes = members.groupBy(video).agg(F.count(F.lit(1)).alias("members"))
    shared = hits.groupBy(video, "slot", "rank").agg(F.count(F.lit(1)).alias("have"), F.first("f").alias("f")).join(sizes, video).filter("have = members")
    shared = shared.groupBy(video, "slot").agg(F.min(F.struct("rank", "f")).alias("joint"))
    own = hits.groupBy(video, member, "slot").agg(F.min(F.struct("rank", "f")).alias("own"))
    each = members.join(slots, F.lit(True)).join(own, [video, member, "slot"], "left").join(shared, [video, "slot"], "left")
    chosen = F.coalesce("joint.f", "own.f")
    out = each.groupBy(video, "slot").agg(
        F.min("joint.rank").alias("rank"), F.count_if(chosen.isNull()).alias("without"), F.array_sort(F.collect_list(F.struct(F.col(member).alias("member"), chosen.alias("frame")))).alias("frames")
    )
    mode = F.when(F.col("rank") == 0, "planned").when(F.col("rank") > 0, "joint").when(F.col("without") == 0, "individual").otherwise("failed")
    return out.select(video, "slot", mode.alias("mode"), "frames")
