"""Which frames go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutplan.functions.frames import SPEED_02X, SPEED_1X, value
from cutplan.operators.lookup import assigned
from cutplan.operators.segments import BLOCK, islands


def pause_deletes(frames: DataFrame, pauses: DataFrame, mask: DataFrame) -> DataFrame:
    """Frames that their pause deletes: all of it in mode `all`, mask values 1 and 2 in mode `auto`.

    (video_id, frame_idx), one row a deleted frame.  mask (video_id, start_frame, frame_idx, m).
    """
    marked = mask.select("video_id", "start_frame", "frame_idx", "m").join(
        pauses.select("video_id", "start_frame", "mode"), ["video_id", "start_frame"]
    )
    gone = (F.col("mode") == "all") | ((F.col("mode") == "auto") & F.col("m").isin(1, 2))
    return marked.where(gone).select("video_id", "frame_idx").join(frames.select("video_id", "frame_idx"), ["video_id", "frame_idx"])


def clip_deletes(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """Frames of a clip outside [keep_in, keep_out]; all of it where keep_in is past keep_out."""
    trimmed = clips.where("keep_in > start_frame OR keep_out < end_frame OR keep_in > keep_out")
    met = assigned(frames, trimmed, F.struct("keep_in", "keep_out"))
    cut = met.where("info.keep_in > info.keep_out OR frame_idx < info.keep_in OR frame_idx > info.keep_out")
    return cut.select("video_id", "frame_idx")


def speedup_deletes(rows: DataFrame, state: int, factor: Column, enabled: Column, deleted: str = "deleted", block: int = BLOCK) -> DataFrame:
    """`deleted` also holds for all but the 1st of every `factor` frames in a run of frames of `state`
    that aren't deleted yet.  A factor below 2 takes none.

    A frame's place in its run is its distance from the run's first frame, and runs are put together from their
    parts in blocks of frames, so no task has more than a block of a video.
    """
    placed = islands(rows, ["video_id"], "frame_idx", ["state", deleted], "_from", "_until", block)
    place = F.col("frame_idx") - F.col("_from")
    taken = enabled & (F.col("state") == state) & ~F.col(deleted) & (factor > 1) & (place % F.greatest(factor, F.lit(1)) != 0)
    return placed.withColumn(deleted, F.col(deleted) | taken).drop("_from", "_until")


def base_deletes(frames: DataFrame, pauses: DataFrame, mask: DataFrame, clips: DataFrame) -> DataFrame:
    """Frames with `deleted`, true by E1 or E2."""
    cut = pause_deletes(frames, pauses, mask).unionByName(clip_deletes(frames, clips)).distinct().withColumn("_cut", F.lit(True))
    joined = frames.select("video_id", "frame_idx", "state").join(cut, ["video_id", "frame_idx"], "left")
    return joined.withColumn("deleted", F.coalesce("_cut", F.lit(False))).drop("_cut")


def delete_mask(base: DataFrame, speedup_1x: bool | Column = True, speedup_02: bool | Column = True, factor_02: int | Column = 10) -> DataFrame:
    """`deleted` by E1 or E2, then decimation of 1x frames by 2 and of 0.2x frames by `factor_02`."""
    fast = speedup_deletes(base, SPEED_1X, F.lit(2), value(speedup_1x, "boolean"))
    return speedup_deletes(fast, SPEED_02X, value(factor_02, "int"), value(speedup_02, "boolean"))


def deletes_from_list(frames: DataFrame, listed: DataFrame) -> DataFrame:
    """E5: `deleted` for frames that a list (video_id, frame_idx) names; numbers without a frame are ignored."""
    marks = listed.select("video_id", "frame_idx").dropDuplicates().withColumn("_cut", F.lit(True))
    joined = frames.select("video_id", "frame_idx", "state").join(marks, ["video_id", "frame_idx"], "left")
    return joined.withColumn("deleted", F.coalesce("_cut", F.lit(False))).drop("_cut")
