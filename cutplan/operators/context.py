"""Boundary records of earlier runs: building and checking them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 1
RECORDS = "array<struct<start:bigint,end:bigint,before_index:bigint,after_index:bigint,diff:double>>"


def build_context(boundaries: DataFrame, lengths: DataFrame) -> DataFrame:
    """C11: (video_id, version, complete, frame_count, decoded_frame_count, pause_boundary_diffs).

    boundaries: pauses with before_index, after_index, boundary_diff; one whose difference is unknown is
    left out and makes the context incomplete.
    """
    record = F.struct(
        F.col("start_frame").alias("start"), F.col("end_frame").alias("end"), "before_index", "after_index", F.col("boundary_diff").alias("diff")
    )
    known = F.col("boundary_diff").isNotNull()
    per = boundaries.groupBy("video_id").agg(
        F.sort_array(F.collect_list(F.when(known, record))).alias("records"), F.count_if(~known).alias("skipped")
    )
    joined = lengths.join(per, "video_id", "left")
    return joined.select(
        "video_id",
        F.lit(VERSION).alias("version"),
        ((F.coalesce("skipped", F.lit(0)) == 0) & (F.col("total") > 0)).alias("complete"),
        F.col("total").alias("frame_count"),
        F.col("total").alias("decoded_frame_count"),
        F.coalesce("records", F.array().cast(RECORDS)).alias("pause_boundary_diffs"),
    )


def validate_context(context: DataFrame, pauses: DataFrame, lengths: DataFrame) -> DataFrame:
    """(video_id, usable): all or nothing per video of `lengths`; a video without a context isn't usable."""
    records = context.select("video_id", F.posexplode("pause_boundary_diffs").alias("pause_id", "rec"))
    p = pauses.select("video_id", "pause_id", "start_frame", "end_frame")
    both = records.join(p, ["video_id", "pause_id"], "full").join(lengths, "video_id")
    good = (
        (F.col("rec.start") == F.col("start_frame"))
        & (F.col("rec.end") == F.col("end_frame"))
        & (F.col("rec.before_index") == F.greatest(F.lit(0), F.col("start_frame") - 1))
        & (F.col("rec.after_index") == F.least(F.col("total") - 1, F.col("end_frame") + 1))
        & ~F.isnan("rec.diff")
        & (F.abs("rec.diff") != float("inf"))
    )
    rows = both.groupBy("video_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("same"))
    heads = lengths.join(context, "video_id", "left").join(rows, "video_id", "left")
    usable = (
        (F.col("version") == VERSION)
        & F.col("complete")
        & (F.col("frame_count") == F.col("total"))
        & (F.col("decoded_frame_count") == F.col("total"))
        & F.coalesce("same", F.lit(True))
    )
    return heads.select("video_id", F.coalesce(usable, F.lit(False)).alias("usable"))


def reuse_boundaries(context: DataFrame, pauses: DataFrame, frames: DataFrame, lengths: DataFrame) -> DataFrame:
    """Boundary differences from contexts that check out, computed anew for all other videos."""
    from cutplan.operators.segments import boundary_diff

    usable = validate_context(context, pauses, lengths).where("usable").select("video_id")
    records = context.join(usable, "video_id", "left_semi").select("video_id", F.explode("pause_boundary_diffs").alias("r"))
    kept = records.select("video_id", F.col("r.start").alias("start_frame"), "r.before_index", "r.after_index", F.col("r.diff").alias("boundary_diff"))
    old = pauses.join(kept, ["video_id", "start_frame"]).select(*pauses.columns, "before_index", "after_index", "boundary_diff")
    new = boundary_diff(pauses.join(usable, "video_id", "left_anti"), frames.join(usable, "video_id", "left_anti"), lengths)
    return old.unionByName(new)
