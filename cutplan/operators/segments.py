"""Runs, pauses, speed sections, clips, boundary differences and modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutplan.functions.frames import PAUSE, mean_abs_diff, value


#: Frames of one video that a task has at most, where work is done in blocks.
BLOCK = 100_000


def blocked(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows with `_block`, `block` frames each, and `_own`; the frames at a block's edges are in the next
    block too, not as its own, so that windows over (video_id, _block) see each frame's neighbours."""
    number, place = F.floor(F.col("frame_idx") / block), F.col("frame_idx") % block
    at = lambda b, own: F.struct(b.alias("b"), F.lit(own).alias("own"))
    places = (
        F.when((place == 0) & (place == block - 1), F.array(at(number - 1, False), at(number, True), at(number + 1, False)))
        .when(place == 0, F.array(at(number - 1, False), at(number, True)))
        .when(place == block - 1, F.array(at(number, True), at(number + 1, False)))
        .otherwise(F.array(at(number, True)))
    )
    dealt = rows.withColumn("_at", F.explode(places))
    return dealt.withColumns({"_block": F.col("_at.b"), "_own": F.col("_at.own")}).drop("_at")


def islands(
    rows: DataFrame, keys: list[str], order: str, values: list[str], start: str = "run_start", end: str = "run_end", block: int | None = None
) -> DataFrame:
    """Adds the first and last `order` of the run of equal `values` that a row is in.

    `order` is dense within a run: row number in (keys, values) less `order` is constant on it.  All
    windows start with `keys`, so one exchange serves them.  With `block`, windows end at every `block`
    of `order` and runs are put together on the table of their parts, so that one key with a large
    share of all rows is spread over tasks.
    """
    scope = keys
    if block:
        rows, scope = rows.withColumn("_block", F.floor(F.col(order) / block)), [*keys, "_block"]
    ranked = W.partitionBy(*scope, *values).orderBy(order)
    run = W.partitionBy(*scope, *values, "_group")
    marked = (
        rows.withColumn("_group", F.col(order) - F.row_number().over(ranked))
        .withColumn(start, F.min(order).over(run))
        .withColumn(end, F.max(order).over(run))
        .drop("_group")
    )
    if not block:
        return marked
    parts = marked.groupBy(*scope, *values, start).agg(F.max(end).alias("_e"))
    along = W.partitionBy(*keys).orderBy(start)
    same = F.lag("_e").over(along) == F.col(start) - 1
    for v in values:
        same &= F.lag(v).over(along).eqNullSafe(F.col(v))
    numbered = parts.withColumn("_n", F.sum(F.when(same, 0).otherwise(1)).over(along))
    whole = W.partitionBy(*keys, "_n")
    found = numbered.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(scope)],
        F.col(start).alias("_s"),
        F.min(start).over(whole).alias("_first"),
        F.max("_e").over(whole).alias("_last"),
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(scope)] + [F.col(start) == F.col("_s")]
    joined = marked.join(found, on).withColumn(start, F.col("_first")).withColumn(end, F.col("_last"))
    return joined.drop("_block", "_s", "_first", "_last", *[f"_k{i}" for i in range(len(scope))])


def state_runs(frames: DataFrame, block: int = 100_000) -> DataFrame:
    """(video_id, state, start_frame, end_frame).

    Runs are formed within blocks of `block` frames first and neighbouring ones joined on the much
    smaller table of runs, so a very long video is spread over tasks.
    """
    return runs_in_blocks(frames.select("video_id", "frame_idx", "state", F.floor(F.col("frame_idx") / block).alias("_block")))


def runs_in_blocks(rows: DataFrame) -> DataFrame:
    """C1 of (video_id, frame_idx, state, _block), each frame in one block."""
    ranked = W.partitionBy("video_id", "_block", "state").orderBy("frame_idx")
    parts = (
        rows.withColumn("_group", F.col("frame_idx") - F.row_number().over(ranked))
        .groupBy("video_id", "_block", "state", "_group")
        .agg(F.min("frame_idx").alias("s"), F.max("frame_idx").alias("e"))
    )
    along = W.partitionBy("video_id").orderBy("s")
    joins = (F.lag("state").over(along) == F.col("state")) & (F.lag("e").over(along) == F.col("s") - 1)
    numbered = parts.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(along))
    return (
        numbered.groupBy("video_id", "_run", "state")
        .agg(F.min("s").alias("start_frame"), F.max("e").alias("end_frame"))
        .select("video_id", "state", "start_frame", "end_frame")
    )


def pause_segments(runs: DataFrame) -> DataFrame:
    """(video_id, pause_id, start_frame, end_frame), ids dense from 0 in time order."""
    by_time = W.partitionBy("video_id").orderBy("start_frame")
    return runs.where(F.col("state") == PAUSE).select(
        "video_id", (F.row_number().over(by_time) - 1).alias("pause_id"), "start_frame", "end_frame"
    )


def speed_segments(runs: DataFrame) -> DataFrame:
    """(video_id, type, start_frame, end_frame) of the sped-up and slowed sections."""
    return runs.where(F.col("state").isin(2, 3, 4)).select("video_id", F.col("state").alias("type"), "start_frame", "end_frame")


def totals(frames: DataFrame) -> DataFrame:
    """(video_id, total): a video's length is its number of frame rows."""
    return frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("total"))


def clip_segments(pauses: DataFrame, lengths: DataFrame) -> DataFrame:
    """C4: what pauses leave of [0, total), with keep_in and keep_out at its edges and dense ids."""
    ends = pauses.select("video_id", F.col("start_frame").alias("until"), F.col("end_frame").alias("last"))
    tails = lengths.select("video_id", F.col("total").alias("until"), F.lit(None).cast("long").alias("last"))
    by_time = W.partitionBy("video_id").orderBy("until")
    gaps = ends.unionByName(tails).select(
        "video_id", (F.coalesce(F.lag("last").over(by_time), F.lit(-1)) + 1).alias("start_frame"), (F.col("until") - 1).alias("end_frame")
    )
    dense = W.partitionBy("video_id").orderBy("start_frame")
    return gaps.where("start_frame <= end_frame").select(
        "video_id",
        (F.row_number().over(dense) - 1).alias("clip_id"),
        "start_frame",
        "end_frame",
        F.col("start_frame").alias("keep_in"),
        F.col("end_frame").alias("keep_out"),
    )


def boundary_diff(pauses: DataFrame, frames: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds before_index, after_index and boundary_diff (null where one of the frames is missing)."""
    edges = (
        pauses.join(lengths, "video_id")
        .withColumn("before_index", F.greatest(F.lit(0), F.col("start_frame") - 1))
        .withColumn("after_index", F.least(F.col("total") - 1, F.col("end_frame") + 1))
    )
    pixels = frames.select("video_id", "frame_idx", "gray")
    before = pixels.select("video_id", F.col("frame_idx").alias("before_index"), F.col("gray").alias("gray_before"))
    after = pixels.select("video_id", F.col("frame_idx").alias("after_index"), F.col("gray").alias("gray_after"))
    both = edges.join(before, ["video_id", "before_index"], "left").join(after, ["video_id", "after_index"], "left")
    return both.withColumn("boundary_diff", mean_abs_diff(F.col("gray_before"), F.col("gray_after"))).select(
        *pauses.columns, "before_index", "after_index", "boundary_diff"
    )


def pause_modes(pauses: DataFrame, boundary_thresh: float | Column) -> DataFrame:
    """Adds `mode`: `all` where the boundary difference is known and below the threshold, else `auto`."""
    return pauses.withColumn("mode", F.when(F.col("boundary_diff") < value(boundary_thresh, "double"), "all").otherwise("auto"))
