"""Motion in pauses and the still frames to delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutplan.functions.frames import AUTO_DELETE, AUTO_KEEP, PAUSE, value
from cutplan.operators.segments import islands


def pause_activity(frames: DataFrame, motion_thresh: float | Column) -> DataFrame:
    """Frames of pauses with start_frame, end_frame, k, n and `active`.

    A frame is active if its own difference or the next frame's is above the threshold, as floats;
    the difference on entering the pause doesn't count.
    """
    rows = frames.where(F.col("state") == PAUSE).select("video_id", "frame_idx", "state", "diff", value(motion_thresh, "float").alias("_limit"))
    paused, limit = islands(rows, ["video_id"], "frame_idx", ["state"]), F.col("_limit")
    moved = F.col("diff").cast("float") > limit
    inside = W.partitionBy("video_id", "run_start").orderBy("frame_idx")
    own = (F.col("frame_idx") > F.col("run_start")) & moved
    ahead = F.coalesce(F.lead(F.col("diff").cast("float")).over(inside) > limit, F.lit(False))
    return paused.select(
        "video_id",
        F.col("run_start").alias("start_frame"),
        F.col("run_end").alias("end_frame"),
        "frame_idx",
        (F.col("frame_idx") - F.col("run_start")).alias("k"),
        (F.col("run_end") - F.col("run_start") + 1).alias("n"),
        (F.coalesce(own, F.lit(False)) | ahead).alias("active"),
    )


def pause_mask(activity: DataFrame, still_frames: Column) -> DataFrame:
    """(video_id, start_frame, k, frame_idx, m), m 1 where a still frame goes, else 0.

    A still pause keeps `still_frames` at each end; with motion, a still run keeps them on the side
    that borders on it, or half and half if both do.
    """
    sf = still_frames
    runs = islands(activity, ["video_id", "start_frame"], "k", ["active"], "ra", "rb")
    any_active = F.max("active").over(W.partitionBy("video_id", "start_frame"))
    k, n, ra, rb = (F.col(c) for c in ("k", "n", "ra", "rb"))
    half = F.floor(sf / 2)
    gone = (
        F.when(~any_active, (n > 2 * sf) & (k >= sf) & (n - 1 - k >= sf))
        .when(F.col("active") | (rb - ra + 1 <= sf), F.lit(False))
        .when(ra == 0, rb - k >= sf)
        .when(rb == n - 1, k - ra >= sf)
        .otherwise((k - ra >= half) & (rb - k >= sf - half))
    )
    return runs.select(
        "video_id", "start_frame", "k", "frame_idx", F.when(gone, AUTO_DELETE).otherwise(AUTO_KEEP).cast("tinyint").alias("m")
    )
