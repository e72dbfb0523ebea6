"""The delete mask of many videos in one pass over one partitioning.

The same result as composing C1-C8, D4 and E1-E4 by joins: every step is a window whose keys start with
`video_id`, so frames are exchanged once and pixels travel only with them.  Edits are joined per clip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutplan.functions.frames import PAUSE, SPEED_02X, SPEED_1X, mean_abs_diff
from cutplan.operators.deletes import speedup_deletes
from cutplan.operators.segments import islands


def marked_frames(frames: DataFrame, still_frames: int, motion_thresh: float, boundary_thresh: float) -> DataFrame:
    """Frames with the pause or clip they are in: in_pause, run_start, run_end, clip_id, mode and m (null off pauses)."""
    along = W.partitionBy("video_id").orderBy("frame_idx")
    rows = frames.select(
        "video_id",
        "frame_idx",
        "state",
        F.col("diff").cast("float").alias("diff"),
        (F.col("state") == PAUSE).alias("in_pause"),
        "gray",
        F.lag("gray").over(along).alias("_before"),
        F.lead("gray").over(along).alias("_after"),
    )
    runs = islands(rows, ["video_id"], "frame_idx", ["in_pause"])
    # the boundary difference needs pixels at the two ends of a pause only
    run = W.partitionBy("video_id", "run_start")
    at_start = F.when(F.col("in_pause") & (F.col("frame_idx") == F.col("run_start")), F.coalesce("_before", "gray"))
    at_end = F.when(F.col("in_pause") & (F.col("frame_idx") == F.col("run_end")), F.coalesce("_after", "gray"))
    ends = runs.withColumn("_b", at_start).withColumn("_a", at_end).drop("gray", "_before", "_after")
    first, last = F.max("_b").over(run), F.max("_a").over(run)
    limit = F.lit(float(motion_thresh)).cast("float")
    ordered = run.orderBy("frame_idx")
    ahead = F.coalesce(F.lead("diff").over(ordered) > limit, F.lit(False))
    own = (F.col("frame_idx") > F.col("run_start")) & (F.col("diff") > limit)
    opens = F.when(~F.col("in_pause") & (F.col("frame_idx") == F.col("run_start")), 1).otherwise(0)
    flat = ends.select(
        "video_id",
        "frame_idx",
        "state",
        "in_pause",
        "run_start",
        "run_end",
        mean_abs_diff(first, last).alias("boundary_diff"),
        (F.col("in_pause") & (F.coalesce(own, F.lit(False)) | ahead)).alias("active"),
        (F.sum(opens).over(along) - 1).alias("clip_id"),
    )
    still = islands(flat, ["video_id", "run_start"], "frame_idx", ["active"], "_ra", "_rb")
    sf, half = still_frames, still_frames // 2
    k, n = F.col("frame_idx") - F.col("run_start"), F.col("run_end") - F.col("run_start") + 1
    ra, rb = F.col("_ra") - F.col("run_start"), F.col("_rb") - F.col("run_start")
    gone = (
        F.when(~F.max("active").over(run), (n > 2 * sf) & (k >= sf) & (n - 1 - k >= sf))
        .when(F.col("active") | (rb - ra + 1 <= sf), F.lit(False))
        .when(ra == 0, rb - k >= sf)
        .when(rb == n - 1, k - ra >= sf)
        .otherwise((k - ra >= half) & (rb - k >= sf - half))
    )
    mode = F.when(F.col("boundary_diff") < F.lit(float(boundary_thresh)), "all").otherwise("auto")
    return still.select(
        "video_id",
        "frame_idx",
        "state",
        "in_pause",
        "run_start",
        "run_end",
        F.when(~F.col("in_pause"), F.col("clip_id")).cast("int").alias("clip_id"),
        F.when(F.col("in_pause"), mode).alias("mode"),
        F.when(F.col("in_pause"), gone.cast("tinyint")).alias("m"),
    )


def delete_mask(
    frames: DataFrame, trims: DataFrame, still_frames: int, motion_thresh: float, boundary_thresh: float, factor_02: int, speedup_1x: bool = True,
    speedup_02: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(before decimation, after it): video_id, frame_idx, state, deleted.  trims (video_id, clip_id, keep_in, keep_out)."""
    marked = marked_frames(frames, still_frames, motion_thresh, boundary_thresh)
    edited = marked.join(trims.select("video_id", "clip_id", "keep_in", "keep_out"), ["video_id", "clip_id"], "left")
    by_pause = (F.col("mode") == "all") | ((F.col("mode") == "auto") & F.col("m").isin(1, 2))
    by_clip = (F.col("keep_in") > F.col("keep_out")) | (F.col("frame_idx") < F.col("keep_in")) | (F.col("frame_idx") > F.col("keep_out"))
    gone = F.when(F.col("in_pause"), by_pause).otherwise(by_clip)
    base = edited.select("video_id", "frame_idx", "state", F.coalesce(gone, F.lit(False)).alias("deleted"))
    fast = speedup_deletes(base, SPEED_1X, F.lit(2), F.lit(speedup_1x))
    return base, speedup_deletes(fast, SPEED_02X, F.lit(factor_02), F.lit(speedup_02))
