"""Structured Streaming forms: early-stopping decisions, monitoring, incremental scoring, run logs and manifest intake.

Each function takes a streaming (or, for tests, a batch) DataFrame and returns one, or starts a query on given paths.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, repeat
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veraframe.operators.decisions import FAKE, FULL, REAL, UNCERTAIN, Stage
from veraframe.operators.manifests import parse_manifest
from veraframe.operators.tracking import LANDMARKS, OpenTracks

DECISION = "sample_id string, verdict string, reason string, frames_used int"


def _stage_verdict(mean: float, s: Stage) -> str | None:
    """A stage's verdict if its set has one class, else None."""
    import math

    p = 1 / (1 + math.exp(-max(-60.0, min(60.0, mean / s.temperature))))
    real, fake = p <= s.q_real, 1 - p <= s.q_fake
    return (REAL if real else FAKE) if real != fake else None


def _decision(stages: list[Stage], logits: dict[int, float], final: bool) -> tuple[str, str, int] | None:
    """(verdict, reason, frames used) that the frames seen allow; ``final`` decides for want of frames where they allow none."""
    used = 0
    for s in stages:
        slots = range(0, FULL, FULL // s.k)
        if any(x not in logits for x in slots):
            return (UNCERTAIN, f"insufficient_frames_for_k{s.k}", used) if final else None
        used = s.k
        found = _stage_verdict(sum(logits[x] for x in slots) / s.k, s)
        if s is stages[-1]:
            return (found, f"final_k{s.k}_singleton", s.k) if found else (UNCERTAIN, f"final_k{s.k}_uncertain", s.k)
        if found:
            return found, f"confident_singleton_k{s.k}", s.k
    return None


def early_decisions(frames: DataFrame, stages: list[Stage], timeout_ms: int | None = None) -> DataFrame:
    """A decision per video as soon as its frames allow one: frames (sample_id, slot, logit) arrive in any order.

    The state is the video's logits by slot, at most FULL of them; a repeated slot is ignored. The decision is emitted
    once. With a timeout, a video whose frames stay away is decided as uncertain for want of frames.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, slots, values = state.get if state.exists else (False, [], [])
        logits = dict(zip(slots, values, strict=True))
        if not state.hasTimedOut:
            for pdf in batches:
                for slot, logit in zip(pdf["slot"], pdf["logit"], strict=True):
                    logits.setdefault(int(slot), float(logit))
        found = None if done else _decision(stages, logits, state.hasTimedOut)
        done = done or found is not None
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((done, [] if done else list(logits), [] if done else list(logits.values())))
            if timeout_ms is not None and not done:
                state.setTimeoutDuration(timeout_ms)
        if found:
            yield pd.DataFrame([(key[0], *found)], columns=["sample_id", "verdict", "reason", "frames_used"])

    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return frames.groupBy("sample_id").applyInPandasWithState(step, DECISION, "done boolean, slots array<int>, logits array<double>", "append", timeout)


class EarlyDecider(StatefulProcessor):
    """Decides a video as its frames come, with its end in event time.

    The state is the logits by slot (at most FULL), or a mark once the video is decided. A timer stands ``hold_ms`` after the video's
    latest frame; when the watermark passes it, a video without a decision is decided for want of frames and the state goes.
    Frames that old are behind the watermark and dropped, so they can't open a decided video again.
    """

    def __init__(self, stages: list[Stage], hold_ms: int) -> None:
        self.stages, self.hold_ms = stages, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("video", "done boolean, until long, slots array<int>, logits array<double>")

    def decided(self, key: tuple, found: tuple[str, str, int]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *found)], columns=["sample_id", "verdict", "reason", "frames_used"]).astype({"frames_used": "int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, until, slots, values = self.state.get() if self.state.exists() else (False, None, [], [])
        logits, latest = dict(zip(slots, values, strict=True)), until
        for pdf in rows:
            latest = max(latest or 0, int(pdf["at_ms"].max()) + self.hold_ms)
            for slot, logit in zip(pdf["slot"], pdf["logit"], strict=True):
                logits.setdefault(int(slot), float(logit))
        if latest != until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(latest)
        found = None if done else _decision(self.stages, logits, False)
        done = done or found is not None
        self.state.update((done, latest, [] if done else list(logits), [] if done else list(logits.values())))
        if found:
            yield self.decided(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, _, slots, values = self.state.get()
        self.state.clear()
        if not done:
            yield self.decided(key, _decision(self.stages, dict(zip(slots, values, strict=True)), True))

    def close(self) -> None:
        pass


def timed_decisions(frames: DataFrame, stages: list[Stage], late: str = "10 minutes", hold_ms: int = 60_000) -> DataFrame:
    """A decision per video of frames (sample_id, slot, logit, ts) in any order, and none twice; see :class:`EarlyDecider`.

    Of frames with the same slot in one batch, any one counts. A video that goes on more than ``hold_ms`` after its latest frame is a new one.
    Rows without an id belong to no video and are left out.
    """
    marked = timed(frames).filter("sample_id IS NOT NULL").withWatermark("ts", late).withColumn("at_ms", F.unix_millis("ts"))
    return marked.groupBy("sample_id").transformWithStateInPandas(EarlyDecider(stages, hold_ms), DECISION, "append", "eventTime")


def timed(log: DataFrame, ts: str = "ts") -> DataFrame:
    """``log`` with its time as a timestamp, which event time must be; one without a zone is taken in the session's."""
    return log.withColumn(ts, F.col(ts).cast("timestamp"))


def verdict_monitor(log: DataFrame, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and latency by verdict in event-time windows; rows later than the watermark are dropped."""
    spans = F.window("ts", window, slide) if slide else F.window("ts", window)
    grouped = timed(log).withWatermark("ts", late).groupBy(spans.alias("w"), "verdict")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("total_ms").alias("mean_ms"), F.approx_percentile("total_ms", 0.95).alias("p95_ms")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "verdict", "n", "mean_ms", "p95_ms")


def user_sessions(log: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: their span and number of events."""
    grouped = timed(log).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def incremental_scores(frames: DataFrame, score, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Adds the scores of rows that ``out`` lacks; ``score`` maps a DataFrame to one with ``keys`` and the score.

    A batch is a partition of its own, which a retry writes anew. Of what is stored only the keys are read.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(out)
        new = batch.dropDuplicates(keys)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            new = new.join(spark.read.option("basePath", out).parquet(out).filter(F.col("batch") != epoch).select(*keys), keys, "left_anti")
        score(new).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_log_tables(log: DataFrame, out: str, checkpoint: str, by: str = "split") -> StreamingQuery:
    """Appends log rows to Parquet tables partitioned by split."""
    return log.writeStream.format("parquet").partitionBy(by).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifest_intake(lines: DataFrame, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Parses manifest lines as they come: samples go to one table, issues to another.

    A batch is a partition of its own in both, which a retry writes anew.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        parsed = parse_manifest(batch).persist()
        parsed.filter("issue IS NULL").select("sample.*").write.mode("overwrite").parquet(f"{good}/batch={epoch}")
        parsed.filter("issue IS NOT NULL").select("value", "issue").write.mode("overwrite").parquet(f"{bad}/batch={epoch}")
        parsed.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: A detection as the trackers' streams carry it: ``nulls`` has a bit for each of KEYS that is null, so that keys stay integers.
KEYS = {"video_id": "long", "frame_index": "int", "det_key": "long"}
BOXES = ("x", "y", "w", "h", *LANDMARKS)
HELD = [*KEYS, "nulls", "box", "at_ms"]
LINKED = ", ".join(f"{c} {t}" for c, t in KEYS.items()) + ", nulls int, track int"


def _in_buckets(faces: DataFrame, buckets: int, *more: str):
    """Detections grouped by a hash of their video: a bucket's rows reach a tracker in few large frames, not in one a video."""
    nulls = sum((F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(KEYS)), F.lit(0)).alias("nulls")
    held = faces.select(F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int").alias("bucket"), *[F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in KEYS.items()], nulls, F.array(*[F.col(c).cast("double") for c in BOXES]).alias("box"), *more)
    return held.groupBy("bucket")


def _unbucketed(linked: DataFrame) -> DataFrame:
    return linked.select(*[F.when(F.col("nulls").bitwiseAND(1 << i) == 0, F.col(c)).alias(c) for i, c in enumerate(KEYS)], F.when(F.col("track") >= 0, F.col("track")).alias("track"))


class OnlineTracker(StatefulProcessor):
    """Links the detections of a bucket's videos as frames come, by the rule of :func:`track_faces`.

    The state is a map with an entry a video: the open tracks' last rows, the next number and the last frame. Tracks that have
    seen nothing for more than ``max_gap`` frames leave it, and with ``ttl_ms`` the entry of a video without new frames expires.
    Only entries of videos with new frames are read and written. Detections of a frame that is not after the last one are
    late: they come out without a track and change nothing, as do those without a frame.
    """

    def __init__(self, iou_min: float = 0.3, max_gap: int = 2, ttl_ms: int | None = None) -> None:
        self.iou_min, self.max_gap, self.ttl_ms = iou_min, max_gap, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("tracks", "video_id long, unknown boolean", "count int, seen long, rows binary", self.ttl_ms)

    def _resumed(self, video: tuple) -> tuple[OpenTracks, int | None]:
        count, seen, rows = self.state.getValue(video) or (0, None, b"")
        held = np.frombuffer(rows).reshape(-1, 2 + len(BOXES)).tolist()
        return OpenTracks(self.iou_min, self.max_gap, {int(t): (video, int(f), None, None, *box) for t, f, *box in held}, count), seen

    def _linked(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """``pdf`` in the order of videos, frames and detections (of equal keys, in that of their boxes), with ``track`` (-1: none)."""
        boxes, nulls = np.stack(pdf["box"].to_numpy()), pdf["nulls"].to_numpy()
        keys = [pdf[c].to_numpy() for c in KEYS]
        order = np.lexsort((*boxes.T[::-1], *keys[::-1], nulls & 1, nulls & 2))
        keys, nulls, tracks = [k[order] for k in keys], nulls[order], []
        placed = order[: int((nulls & 2 == 0).sum())]  # those without a frame come last
        video, frame, det = (k[: len(placed)].tolist() for k in keys)
        rows = zip(zip(video, (nulls[: len(placed)] & 1 > 0).tolist(), strict=True), frame, det, repeat(None), *boxes[placed].T.tolist())
        for video, frames in groupby(rows, itemgetter(0)):
            linker, seen = self._resumed(video)
            for at, dets in groupby(frames, itemgetter(1)):
                dets = list(dets)
                late = seen is not None and at <= seen
                tracks += [-1] * len(dets) if late else linker.link(dets)
                seen = seen if late else at
            held = [(t, r[1], *r[4:]) for t, r in linker.last.items() if seen - r[1] < self.max_gap]  # the others close at any later frame
            self.state.updateValue(video, (linker.count, seen, np.array(held, dtype="float64").tobytes()))
        tracks += [-1] * (len(order) - len(placed))
        return pd.DataFrame(dict(zip(KEYS, keys, strict=True)) | {"nulls": nulls, "track": tracks})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._linked(pd.concat(list(rows)))

    def close(self) -> None:
        pass


def online_tracks(faces: DataFrame, iou_min: float = 0.3, max_gap: int = 2, ttl_ms: int | None = None, buckets: int = 4096) -> DataFrame:
    """(video_id, frame_index, det_key, track); see :class:`OnlineTracker`. A bucket's rows of a micro-batch are in a task's memory
    at once; a checkpoint is bound to the number of buckets it began with.
    """
    tracker = OnlineTracker(iou_min, max_gap, ttl_ms)
    return _unbucketed(_in_buckets(faces, buckets).transformWithStateInPandas(tracker, LINKED, "append", "none" if ttl_ms is None else "processingTime"))


def _packed(pdf: pd.DataFrame) -> bytes:
    """Detections as Arrow's compressed stream, in the columns' types."""
    batch, out = pa.RecordBatch.from_pandas(pdf, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


class BufferedTracker(OnlineTracker):
    """An :class:`OnlineTracker` that holds detections back until the watermark passes them, and links frames in order.

    Frames may come shuffled within the watermark's delay. The state is what lies after the watermark, packed as it came, the open
    tracks, and each video's end: when the watermark is ``hold_ms`` past a video's last frame, its tracks go. A bucket has one
    timer, at its first waiting frame or its first end.
    """

    def __init__(self, iou_min: float = 0.3, max_gap: int = 2, hold_ms: int = 60_000) -> None:
        super().__init__(iou_min, max_gap)
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first long, rows binary")
        self.times = handle.getValueState("times", "timer long, videos array<long>, ends array<long>")

    def _times(self) -> tuple[int | None, dict[int, int]]:
        timer, videos, ends = self.times.get() if self.times.exists() else (None, [], [])
        return timer, dict(zip(videos, ends, strict=True))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        timer, ends = self._times()
        first = None
        for pdf in rows:
            here = int(pdf["at_ms"].min())
            self.waiting.appendValue((here, _packed(pdf[HELD])))
            first = here if first is None else min(first, here)
            for video, at in pdf.groupby("video_id")["at_ms"].max().items():
                ends[int(video)] = max(ends.get(int(video), 0), int(at) + self.hold_ms)
        if timer is None or first < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            timer = first
        self.times.update((timer, list(ends), list(ends.values())))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, held = timerValues.getCurrentWatermarkInMs(), list(self.waiting.get())
        due, held = [rows for first, rows in held if first <= now], [(first, rows) for first, rows in held if first > now]
        out = []
        if due:
            pdf = pd.concat([pa.ipc.open_stream(rows).read_pandas() for rows in due])
            ready, rest = pdf[pdf["at_ms"] <= now], pdf[pdf["at_ms"] > now]
            out.append(self._linked(ready))
            held += [(int(rest["at_ms"].min()), _packed(rest))] if len(rest) else []
            self.waiting.clear()
            if held:
                self.waiting.appendList(held)
        _, ends = self._times()
        for video in [v for v, end in ends.items() if end <= now]:
            del ends[video]
            self.state.removeKey((video, False))
        following = min([first for first, _ in held] + list(ends.values()), default=None)
        if following is None:
            self.times.clear()
        else:
            self.handle.registerTimer(following)
            self.times.update((following, list(ends), list(ends.values())))
        yield from out


def ordered_tracks(faces: DataFrame, late: str = "10 seconds", iou_min: float = 0.3, max_gap: int = 2, hold_ms: int = 60_000, buckets: int = 4096) -> DataFrame:
    """The batch tracker's tracks of a stream whose frames (with their time ``ts``) come in any order within ``late``.

    Later detections are dropped. A video's frames must be in the order of their times. Rows without a video are left out
    (a null key's timers were seen to keep those of other keys from firing). Buckets are those of :func:`online_tracks`.
    """
    marked = timed(faces).filter("video_id IS NOT NULL").withWatermark("ts", late).withColumn("at_ms", F.unix_millis("ts"))
    return _unbucketed(_in_buckets(marked, buckets, "at_ms", "ts").transformWithStateInPandas(BufferedTracker(iou_min, max_gap, hold_ms), LINKED, "append", "eventTime"))
