"""Cut plans on runs: frames are read once, in blocks, and all that follows works on runs of equal frames.

A block of a video is `block` frames and one more on either side, so that a frame meets its neighbours;
no task has more of one video than that.  Frames of one state (and, in a pause, of one activity) are put
together to runs within their block, and runs that touch across blocks are joined on the far smaller
table of runs.  Masks, trims and decimation of a run are arithmetic on its ends, so the delete mask, the
kept ranges, the next kept frame and the segments need no window over frames at all.

Parameters are numbers, or columns of the frames (or runs) where they differ by video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutplan.functions.frames import PAUSE, SPEED_02X, SPEED_1X, mean_abs_diff, speed_label, value
from cutplan.operators.outputs import STATE_NAMES, joined_fragments, trimmed_edges
from cutplan.operators.segments import BLOCK, blocked


def frame_runs(frames: DataFrame, motion_thresh: float | Column, block: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """(video_id, s, e, state, active, before, after): maximal runs of equal state and activity.

    frames (video_id, frame_idx dense from 0, state, diff, gray).  `before` and `after` are the pixels next
    to a pause, on its first and last run.  `keep` names columns that are constant in a video.
    """
    limit = value(motion_thresh, "float")
    rows = frames.select("video_id", "frame_idx", "state", F.col("diff").cast("float").alias("diff"), "gray", limit.alias("_limit"), *keep)
    return runs_of_blocks(blocked(rows, block), F.col("_limit"), keep)


def runs_of_blocks(dealt: DataFrame, motion_thresh: float | Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """`frame_runs` of rows that are dealt to blocks already, with `_block` and `_own` as `blocked` adds them."""
    limit, diff = value(motion_thresh, "float"), F.col("diff").cast("float")
    along = W.partitionBy("video_id", "_block").orderBy("frame_idx")
    paused, was, will = F.col("state") == PAUSE, F.lag("state").over(along) == PAUSE, F.lead("state").over(along) == PAUSE
    own = was & (diff > limit)
    ahead = will & (F.lead(diff).over(along) > limit)
    marked = dealt.select(
        "video_id",
        "_block",
        "_own",
        "frame_idx",
        "state",
        *keep,
        (paused & (F.coalesce(own, F.lit(False)) | F.coalesce(ahead, F.lit(False)))).alias("active"),
        F.when(paused & ~F.coalesce(was, F.lit(False)), F.coalesce(F.lag("gray").over(along), "gray")).alias("before"),
        F.when(paused & ~F.coalesce(will, F.lit(False)), F.coalesce(F.lead("gray").over(along), "gray")).alias("after"),
    )
    ranked = W.partitionBy("video_id", "_block", "state", "active").orderBy("frame_idx")
    grouped = marked.where("_own").withColumn("_group", F.col("frame_idx") - F.row_number().over(ranked))
    pixels = [F.max("before").alias("before"), F.max("after").alias("after"), *[F.first(c).alias(c) for c in keep]]
    pieces = grouped.groupBy("video_id", "_block", "state", "active", "_group").agg(F.min("frame_idx").alias("s"), F.max("frame_idx").alias("e"), *pixels)
    by_start = W.partitionBy("video_id").orderBy("s")
    goes_on = (F.lag("state").over(by_start) == F.col("state")) & (F.lag("active").over(by_start) == F.col("active")) & (F.lag("e").over(by_start) == F.col("s") - 1)
    numbered = pieces.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(by_start))
    return numbered.groupBy("video_id", "_run", "state", "active").agg(F.min("s").alias("s"), F.max("e").alias("e"), *pixels).drop("_run")


def placed_runs(runs: DataFrame) -> DataFrame:
    """Runs with the pause or clip they are part of: first, last, pause_id or clip_id, any_active, boundary_diff."""
    by_start = W.partitionBy("video_id").orderBy("s")
    paused = F.col("state") == PAUSE
    opens = F.when(F.lag(paused).over(by_start) == paused, 0).otherwise(1)
    counted = runs.withColumn("_open", opens).withColumn("_part", F.sum("_open").over(by_start))
    part = W.partitionBy("video_id", "_part")
    number = lambda mine: (F.sum(F.when(mine, F.col("_open")).otherwise(0)).over(by_start) - 1).cast("int")
    return counted.select(
        *[c for c in runs.columns if c not in ("before", "after")],
        F.min("s").over(part).alias("first"),
        F.max("e").over(part).alias("last"),
        F.max("active").over(part).alias("any_active"),
        F.when(paused, mean_abs_diff(F.max("before").over(part), F.max("after").over(part))).alias("boundary_diff"),
        F.when(paused, number(paused)).alias("pause_id"),
        F.when(~paused, number(~paused)).alias("clip_id"),
    )


def pauses(placed: DataFrame) -> DataFrame:
    return placed.where((F.col("state") == PAUSE) & (F.col("s") == F.col("first"))).select(
        "video_id", "pause_id", F.col("first").alias("start_frame"), F.col("last").alias("end_frame"), "boundary_diff"
    )


def pause_report(placed: DataFrame) -> DataFrame:
    """One row a pause: its ends, how many of its frames are active, the difference of the pixels beside it."""
    active = F.sum(F.when(F.col("active"), F.col("e") - F.col("s") + 1).otherwise(0))
    ends = [F.col("first").alias("start_frame"), F.col("last").alias("end_frame")]
    return placed.where(F.col("state") == PAUSE).groupBy("video_id", "pause_id", *ends, "boundary_diff").agg(active.alias("n_active"))


def clips(placed: DataFrame) -> DataFrame:
    here = placed.where((F.col("state") != PAUSE) & (F.col("s") == F.col("first")))
    return here.select(
        "video_id",
        "clip_id",
        F.col("first").alias("start_frame"),
        F.col("last").alias("end_frame"),
        F.col("first").alias("keep_in"),
        F.col("last").alias("keep_out"),
    )


def decided(
    placed: DataFrame, trims: DataFrame | None, still_frames: int | Column, boundary_thresh: float | Column, factor_02: int | Column = 1,
    speedup_1x: bool | Column = False, speedup_02: bool | Column = False,
) -> DataFrame:
    """Runs with what goes: `gone_a`..`gone_b` of a pause's run, all outside `keep_a`..`keep_b` of a clip's
    run, and of what is kept all but one of `step` frames.  trims (video_id, clip_id, keep_in, keep_out)."""
    rows = placed.withColumns({"keep_in": F.col("first"), "keep_out": F.col("last")})
    if trims is not None:
        edits = trims.select("video_id", "clip_id", F.col("keep_in").alias("_in"), F.col("keep_out").alias("_out"))
        rows = placed.join(edits, ["video_id", "clip_id"], "left").withColumns(
            {"keep_in": F.coalesce("_in", "first"), "keep_out": F.coalesce("_out", "last")}
        )
    paused, s, e = F.col("state") == PAUSE, F.col("s"), F.col("e")
    sf = value(still_frames, "long")
    half = F.floor(sf / 2)
    whole = F.coalesce(F.col("boundary_diff") < value(boundary_thresh, "double"), F.lit(False))
    span = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    gone = (
        F.when(whole, span(s, e))
        .when(~F.col("any_active"), F.when(e - s + 1 > 2 * sf, span(s + sf, e - sf)))
        .when(~F.col("active") & (e - s + 1 > sf), F.when(s == F.col("first"), span(s, e - sf)).when(e == F.col("last"), span(s + sf, e)).otherwise(span(s + half, e - sf + half)))
    )
    fast = (F.col("state") == SPEED_1X) & value(speedup_1x, "boolean")
    slow = (F.col("state") == SPEED_02X) & value(speedup_02, "boolean")
    step = F.when(fast, 2).when(slow, F.greatest(F.lit(1), value(factor_02, "int"))).otherwise(1)
    return rows.select(
        "video_id",
        "s",
        "e",
        "state",
        "first",
        F.when(paused, F.when(whole, "all").otherwise("auto")).alias("mode"),
        F.when(paused, gone).alias("_gone"),
        F.when(~paused, F.greatest(s, "keep_in")).alias("keep_a"),
        F.when(~paused, F.least(e, "keep_out")).alias("keep_b"),
        step.alias("step"),
    ).select("video_id", "s", "e", "state", "first", "mode", F.col("_gone.a").alias("gone_a"), F.col("_gone.b").alias("gone_b"), "keep_a", "keep_b", "step")


def delete_mask(runs: DataFrame) -> DataFrame:
    """(video_id, frame_idx, state, deleted), every frame of `decided` runs."""
    i, paused = F.col("frame_idx"), F.col("state") == PAUSE
    in_pause = F.coalesce(i.between(F.col("gone_a"), F.col("gone_b")), F.lit(False))
    in_clip = ~i.between(F.col("keep_a"), F.col("keep_b")) | ((i - F.col("keep_a")) % F.col("step") != 0)
    frames = runs.withColumn("frame_idx", F.explode(F.sequence("s", "e")))
    return frames.select("video_id", "frame_idx", "state", F.when(paused, in_pause).otherwise(in_clip).alias("deleted"))


def _kept(runs: DataFrame) -> Column:
    """array<struct<a, b>> of what a run keeps, before decimation."""
    span = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    paused = F.when(F.col("gone_a").isNull(), F.array(span(F.col("s"), F.col("e")))).otherwise(
        F.array(span(F.col("s"), F.col("gone_a") - 1), span(F.col("gone_b") + 1, F.col("e")))
    )
    every = F.when(F.col("state") == PAUSE, paused).otherwise(F.array(span(F.col("keep_a"), F.col("keep_b"))))
    return F.filter(every, lambda x: x["a"] <= x["b"])


def kept_ranges(runs: DataFrame) -> DataFrame:
    """(video_id, start_frame, end_excl); a decimated run is ranges of one frame."""
    parts = runs.select("video_id", "step", F.explode(_kept(runs)).alias("r"))
    single = F.transform(F.sequence(F.col("r.a"), F.col("r.b"), F.col("step").cast("long")), lambda x: F.struct(x.alias("a"), x.alias("b")))
    parts = parts.select("video_id", F.explode(F.when(F.col("step") > 1, single).otherwise(F.array("r"))).alias("r"))
    along = W.partitionBy("video_id").orderBy("r.a")
    fresh = F.when(F.lag("r.b").over(along) == F.col("r.a") - 1, 0).otherwise(1)
    numbered = parts.withColumn("_new", fresh).withColumn("_n", F.sum("_new").over(along))
    return numbered.groupBy("video_id", "_n").agg(F.min("r.a").alias("start_frame"), (F.max("r.b") + 1).alias("end_excl")).drop("_n")


def skip_ranges(runs: DataFrame, trimmed: DataFrame) -> DataFrame:
    """from `decided` runs and trimmed clips, half-open: whole pauses of mode `all`, deleted spans of
    pauses of mode `auto` (a span never touches the next, since activity is between), cut-off edges of clips."""
    opens = F.col("s") == F.col("first")
    last = F.max("e").over(W.partitionBy("video_id", "first"))
    pause = runs.where(F.col("state") == PAUSE).withColumn("last", last)
    whole = pause.where((F.col("mode") == "all") & opens).select("video_id", F.col("first").alias("start_frame"), (F.col("last") + 1).alias("end_excl"))
    parts = pause.where("mode = 'auto' AND gone_a IS NOT NULL").select("video_id", F.col("gone_a").alias("start_frame"), (F.col("gone_b") + 1).alias("end_excl"))
    return whole.unionByName(parts).unionByName(trimmed_edges(trimmed))


def next_kept(runs: DataFrame) -> DataFrame:
    """F3 before decimation: for each frame the first kept one at or after it, or the video's length."""
    onward = W.partitionBy("video_id").orderBy("s").rowsBetween(1, W.unboundedFollowing)
    kept = runs.select("video_id", "s", "e", _kept(runs).alias("kept"))
    kept = kept.withColumn("after", F.min(F.get("kept", F.lit(0))["a"]).over(onward))
    kept = kept.withColumn("after", F.coalesce("after", F.max("e").over(W.partitionBy("video_id")) + 1))
    frames = kept.withColumn("frame_idx", F.explode(F.sequence("s", "e")))
    i = F.col("frame_idx")
    here = lambda k: F.when(i <= F.get("kept", F.lit(k))["b"], F.greatest(i, F.get("kept", F.lit(k))["a"]))
    return frames.select("video_id", "frame_idx", F.coalesce(here(0), here(1), F.col("after")).alias("next_frame"))


def segments(runs: DataFrame, split_by_speed: bool | Column = False, merge_pause: bool | Column = True) -> DataFrame:
    """F4-F8 on `decided` runs without decimation; the result is that of `outputs.segments`."""
    other = F.when(value(split_by_speed, "boolean"), speed_label(F.col("state"))).otherwise("normal")
    label = F.when(F.col("state") == PAUSE, F.when(value(merge_pause, "boolean"), "pause_merged").otherwise("pause")).otherwise(other)
    parts = runs.select("video_id", label.alias("label"), F.when(F.col("state") == PAUSE, F.col("first")).alias("ps"), F.explode(_kept(runs)).alias("r"))
    return joined_fragments(parts.select("video_id", "label", "ps", "r.a", "r.b"))


def edit_summary(runs: DataFrame) -> DataFrame:
    """F11 from `decided` runs: one aggregation, on counts that follow from a run's ends."""
    kept = F.aggregate(_kept(runs), F.lit(0).cast("long"), lambda n, r: n + F.floor((r["b"] - r["a"]) / F.col("step")) + 1)
    sized = runs.select("video_id", "s", "e", "state", "first", (F.col("e") - F.col("s") + 1).alias("n"), kept.alias("kept"))
    # activity splits a pause into several runs; its first run stands for it
    opens = F.col("s") == F.col("first")
    return sized.groupBy("video_id").agg(
        F.sum("n").alias("total"),
        F.sum("kept").alias("kept"),
        F.sum(F.col("n") - F.col("kept")).alias("gone"),
        *[F.sum(F.when(F.col("state") == k, F.col("kept")).otherwise(0)).alias(f"kept_{name}") for k, name in STATE_NAMES.items()],
        F.count_if((F.col("state") == PAUSE) & opens).alias("n_pauses"),
        F.count_if(F.col("state").isin(2, 3, 4)).alias("n_speeds"),
    )
