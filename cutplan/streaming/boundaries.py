"""Boundary tracking as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cutplan.functions.frames import PAUSE
from cutplan.operators.context import RECORDS, VERSION

OUT = "kind string, video_id long, start_frame long, end_frame long, before_index long, after_index long, diff double"
RECORD = Row(*[f.split(" ")[0] for f in OUT.split(", ")])
STATE = "next_idx long, prev array<double>, open_start long, before array<double>, ended boolean, early int"
HELD = "frame_idx long, state int, gray array<double>, is_last boolean"

Frame = tuple[int, int, list[float] | None, bool]


def _mean_abs(a: list[float] | None, b: list[float] | None) -> float | None:
    if not a or not b or len(a) != len(b) or None in a or None in b:
        return None
    return float(np.abs(np.subtract(a, b, dtype=np.float64)).mean())


@dataclass
class Video:
    """Where the tracking of a video stands: the next frame it waits for, the frame before, and an open pause with the frame before that."""

    video_id: int
    next_idx: int = 0
    prev: list[float] | None = None
    start: int | None = None
    before: list[float] | None = None
    ended: bool = False
    out: list[Row] = field(default_factory=list)

    def _emit(self, kind: str, start: int, end: int, before: int | None = None, after: int | None = None, diff: float | None = None) -> None:
        self.out.append(RECORD(kind, self.video_id, start, end, before, after, diff))

    def _close(self, end: int, after: int, gray: list[float] | None) -> None:
        """The open pause ends at `end`; where its difference can't be told, its frames have no record."""
        diff = _mean_abs(self.before, gray)
        self._emit("skipped" if diff is None else "pause", self.start, end, max(0, self.start - 1), after, diff)
        self.start = self.before = None

    def lose(self, until: int) -> None:
        """Frames before `until` that haven't come are lost."""
        if until > self.next_idx:
            self._emit("lost", self.next_idx, until - 1)
            self.next_idx = until

    def take(self, frame: Frame) -> None:
        """The next frame; pixels are looked at only where a pause opens or closes."""
        idx, state, gray, last = frame
        if state == PAUSE and self.start is None:
            self.start, self.before = idx, gray if self.prev is None else self.prev
        elif state != PAUSE and self.start is not None:
            self._close(idx - 1, idx, gray)
        self.prev, self.next_idx = gray, idx + 1
        if last:
            self.finish()

    def finish(self) -> None:
        """No frame follows: an open pause ends with the last one."""
        if self.start is not None:
            self._close(self.next_idx - 1, self.next_idx - 1, self.prev)
        self._emit("end", 0, self.next_idx - 1)
        self.ended = True

    def advance(self, waiting: list[Frame], max_held: int) -> list[Frame]:
        """Takes what is in order; frames that are missing before more than `max_held` others are lost.  Gives what still waits."""
        first = {f[0]: f for f in reversed(waiting) if f[0] >= self.next_idx}
        waiting = [first[i] for i in sorted(first)]
        for k, frame in enumerate(waiting):
            if self.ended:
                self._emit("late", frame[0], frame[0])
                continue
            if frame[0] != self.next_idx:
                if len(waiting) - k <= max_held:
                    return waiting[k:]
                self.lose(frame[0])
            self.take(frame)
        return []


class BoundaryTracker(StatefulProcessor):
    """State of a video: a `Video`, and frames that came early, which are held.  A frame below the next one is a repeat and
    dropped.  Once more than `max_held` wait, the frames before the first of them count as lost and it goes on there.
    `early` is their number, so that their list is read and written only for a video that has some.

    With `idle_ms` a timer runs for each video, set anew by every frame: when it expires, the video has ended as if its
    last frame had been marked, frames still missing before held ones are lost, and later frames are late.  An ended
    video is remembered for `keep_ms`, so that repeats of its frames open nothing; then its state expires."""

    def __init__(self, max_held: int, idle_ms: int | None = None, keep_ms: int | None = None):
        self.max_held, self.idle_ms, self.keep_ms = max_held, idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", STATE, self.keep_ms)
        self.held = handle.getListState("held", HELD, self.keep_ms)

    def _read(self, key: tuple) -> tuple[Video, list[Frame]]:
        place = self.place.get()
        if place is None:
            return Video(key[0]), []
        *rest, early = place
        return Video(key[0], *rest), [tuple(f) for f in self.held.get()] if early else []

    def _write(self, video: Video, early: int, waiting: list[Frame]) -> Iterator[Row]:
        self.place.update((video.next_idx, video.prev, video.start, video.before, video.ended, len(waiting)))
        if waiting:
            self.held.put(waiting)
        elif early:
            self.held.clear()
        return iter(video.out)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        video, early = self._read(key)
        waiting = video.advance([*early, *((r.frame_idx, r.state, r.gray, r.is_last) for r in rows)], self.max_held)
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if not video.ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        return self._write(video, len(early), waiting)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        video, waiting = self._read(key)
        if not video.ended:
            video.advance(waiting, 0)
            if not video.ended:
                video.finish()
        return self._write(video, len(waiting), [])

    def close(self) -> None:
        pass


def track(stream: DataFrame, max_held: int = 1000, idle_ms: int | None = None, keep_ms: int | None = None) -> DataFrame:
    """What happens in each video, as (kind, video_id, start_frame, end_frame, before_index, after_index, diff).

    stream (video_id, frame_idx, state, gray, is_last).  `pause`: a pause run, when it closes, with its boundary record;
    `skipped`: one whose difference can't be told; `lost`: frames that never came; `late`: frames after the end; `end`:
    all frames of a video.  A video ends with a frame marked is_last, or after `idle_ms` without a frame.

    With timers a query goes on without new frames, so its trigger is a processing time, not all that is available now.
    Needs the RocksDB state store; state is two frames a video and at most `max_held` that came early.  `keep_ms` (by
    default ten times `idle_ms`) after its last change a video's state is dropped.
    """
    if idle_ms is not None:
        keep_ms = 10 * idle_ms if keep_ms is None else keep_ms
        if keep_ms <= idle_ms:
            raise ValueError("keep_ms must be longer than idle_ms, or videos are forgotten before they end")
    elif keep_ms is not None:
        raise ValueError("keep_ms needs idle_ms")
    rows = stream.selectExpr("video_id", "frame_idx", "state", "CAST(gray AS ARRAY<DOUBLE>) AS gray", "coalesce(is_last, false) AS is_last")
    mode = "None" if idle_ms is None else "ProcessingTime"
    return rows.groupBy("video_id").transformWithState(BoundaryTracker(max_held, idle_ms, keep_ms), outputStructType=OUT, outputMode="Append", timeMode=mode)


def track_boundaries(stream: DataFrame, max_held: int = 1000, idle_ms: int | None = None, keep_ms: int | None = None) -> DataFrame:
    """One record per pause run, when it closes: (video_id, start_frame, end_frame, before_index, after_index, diff)."""
    return track(stream, max_held, idle_ms, keep_ms).where("kind = 'pause'").drop("kind")


def context_of_records(records: DataFrame) -> DataFrame:
    """C11 from the stored records of `track`: the context of each video that has ended, as `build_context` gives it.

    It is complete if the video has frames and none of its frames was lost or late and no pause was skipped.
    """
    record = F.struct(F.col("start_frame").alias("start"), F.col("end_frame").alias("end"), "before_index", "after_index", "diff")
    frames = F.col("end_frame") - F.col("start_frame") + 1
    lost = F.sum(F.when(F.col("kind") == "lost", frames).otherwise(0))
    per = records.groupBy("video_id").agg(
        F.max(F.when(F.col("kind") == "end", frames)).alias("total"),
        lost.alias("lost"),
        F.count_if(F.col("kind").isin("lost", "late", "skipped")).alias("missed"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "pause", record))).cast(RECORDS).alias("records"),
    )
    return per.where("total IS NOT NULL").select(
        "video_id",
        F.lit(VERSION).alias("version"),
        ((F.col("missed") == 0) & (F.col("total") > 0)).alias("complete"),
        F.col("total").alias("frame_count"),
        (F.col("total") - F.col("lost")).alias("decoded_frame_count"),
        F.col("records").alias("pause_boundary_diffs"),
    )
