"""Lookups of single frames and of the viewport."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutplan.functions.frames import SPEED_02X, SPEED_1X, speed_label
from cutplan.operators.segments import BLOCK


def assigned(points: DataFrame, segs: DataFrame, info: Column, block: int = BLOCK) -> DataFrame:
    """(video_id, frame_idx, info) of each point, `info` of the segment that it is in, or null.

    segs have start_frame and end_frame and don't overlap.  Segments are dealt to the blocks of frames that they
    meet, cut at their edges, so there are at most as many pieces as segments and blocks together; one sort of
    points and pieces within each block finds the last piece that starts at or before a point.  Points are read once, and
    no task has more than a block of a video.
    """
    met = F.explode(F.sequence(F.floor(F.col("start_frame") / block), F.floor(F.col("end_frame") / block)))
    cut = segs.where("start_frame <= end_frame").select("video_id", "start_frame", F.struct("end_frame", info.alias("info")).alias("_seg"), met.alias("_block"))
    held = cut.select("video_id", "_block", F.greatest("start_frame", F.col("_block") * block).alias("frame_idx"), "_seg", F.lit(0).alias("_kind"))
    asked = points.select(
        "video_id", F.floor(F.col("frame_idx") / block).alias("_block"), "frame_idx", F.lit(None).cast(held.schema["_seg"].dataType).alias("_seg"), F.lit(1).alias("_kind")
    )
    along = W.partitionBy("video_id", "_block").orderBy("frame_idx", "_kind")
    found = held.unionByName(asked).withColumn("_seg", F.last("_seg", ignorenulls=True).over(along)).where("_kind = 1")
    return found.select("video_id", "frame_idx", F.when(F.col("_seg.end_frame") >= F.col("frame_idx"), F.col("_seg.info")).alias("info"))


def frame_info(points: DataFrame, pauses: DataFrame, speeds: DataFrame) -> DataFrame:
    """G1: (video_id, frame_idx, kind, pause_id, mode, boundary_diff, type) of each point: its pause, else
    its speed section, else `normal`."""
    facts = ["pause_id", "mode", "boundary_diff", "type"]
    segs = pauses.select("video_id", "start_frame", "end_frame", *facts[:3]).unionByName(
        speeds.select("video_id", "start_frame", "end_frame", "type"), allowMissingColumns=True
    )
    met = assigned(points.select("video_id", "frame_idx").distinct(), segs, F.struct(*facts))
    both = met.select("video_id", "frame_idx", "info.*")
    kind = F.when(F.col("pause_id").isNotNull(), "pause").when(F.col("type").isNotNull(), speed_label(F.col("type"))).otherwise("normal")
    return both.withColumn("kind", kind).withColumn("boundary_diff", F.when(F.col("kind") == "pause", F.coalesce("boundary_diff", F.lit(0.0))))


def effective_speed(state: Column, speedup_1x: Column, speedup_02: Column, factor_02: Column, preview: Column) -> tuple[Column, Column]:
    """The speed as the label shows it (times the preview's), and the step in frames, at least 2 for 0.2x."""
    fast = (state == SPEED_1X) & speedup_1x
    slow = (state == SPEED_02X) & speedup_02
    label = F.when(fast, 2).when(slow, factor_02).otherwise(1).cast("double") * preview.cast("double")
    return label, F.when(fast, 2).when(slow, F.greatest(F.lit(2), factor_02)).otherwise(1).cast("int")


def bin_number(frame: Column, total: Column, width: int, zoom: float, scroll: float) -> Column:
    """The bin of a frame in a viewport of `width` bins; outside of it, a number below 0 or from `width` on."""
    share = frame.cast("double") / total.cast("double")
    return F.floor((share - F.lit(float(scroll))) * F.lit(float(zoom)) * F.lit(float(width))).cast("long")


def shown_bins(counts: DataFrame) -> DataFrame:
    """(video_id, bin, n_frames, n_deleted, state) from counts (video_id, bin, state, n, d) of any parts of bins."""
    by_state = counts.groupBy("video_id", "bin", "state").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return by_state.groupBy("video_id", "bin").agg(
        F.sum("n").alias("n_frames"), F.sum("d").alias("n_deleted"), F.max_by("state", F.struct("n", -F.col("state"))).alias("state")
    )


def timeline_bins(frames: DataFrame, lengths: DataFrame, width: int, zoom: float = 1.0, scroll: float = 0.0) -> DataFrame:
    """Per visible bin its frames, deleted frames and most frequent state (the smallest of equals).

    Counts by state come first, so a bin's rows are at most one a state.  For many viewports of one mask see `pyramid`.
    """
    bin_no = bin_number(F.col("frame_idx"), F.col("total"), width, zoom, scroll)
    seen = frames.join(lengths, "video_id").withColumn("bin", bin_no).where(F.col("bin").between(0, width - 1))
    return shown_bins(seen.select("video_id", "bin", "state", F.lit(1).alias("n"), F.col("deleted").cast("int").alias("d")))
