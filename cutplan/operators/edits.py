"""Edits by people, held in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutplan.functions.frames import value
from cutplan.operators.lookup import assigned
from cutplan.operators.segments import BLOCK, islands


def apply_mode_batch(pauses: DataFrame, mode: str | Column, boundary_thresh: float | Column) -> DataFrame:
    """One mode for all pauses, or one by video; mode and threshold are values or columns of the pauses.  `auto` checks the boundary again, an unknown one counting as 0;
    masks are then the computed ones, so edits of masks are lost: see `apply_edits`."""
    wanted = value(mode, "string")
    near = F.coalesce("boundary_diff", F.lit(0.0)) < value(boundary_thresh, "double")
    return pauses.withColumn("mode", F.when((wanted == "auto") & near, "all").otherwise(wanted))


def apply_mode_edits(pauses: DataFrame, edits: DataFrame) -> DataFrame:
    """The latest edit of a pause sets its mode; the boundary isn't checked again.  What edits of modes
    do to masks is in `apply_edits`."""
    last = edits.groupBy("video_id", "pause_id").agg(F.max_by("mode", "seq").alias("_edited"))
    return pauses.join(last, ["video_id", "pause_id"], "left").withColumn("mode", F.coalesce("_edited", "mode")).drop("_edited")


def mask_runs(mask: DataFrame, block: int = BLOCK) -> DataFrame:
    """(video_id, pause_id, runs): masks (video_id, pause_id, k, m) as sorted runs of equal values, array<struct<a, b, m>>."""
    key = ["video_id", "pause_id"]
    found = islands(mask.select(*key, "k", "m"), key, "k", ["m"], "a", "b", block).select(*key, "a", "b", "m").distinct()
    run = F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("m").cast("tinyint").alias("m"))
    return found.groupBy(*key).agg(F.sort_array(F.collect_list(run)).alias("runs"))


def toggled(runs: Column, k: Column) -> Column:
    """Runs with the one that holds place k flipped, 0 and 3 to 2, 1 and 2 to 3, and one with neighbours that are equal then."""

    def put(hit: Column) -> Column:
        flipped = F.when(hit["m"].isin(0, 3), 2).otherwise(3).cast("tinyint")
        beside = F.filter(runs, lambda r: (r["m"] == flipped) & ((r["b"] == hit["a"] - 1) | (r["a"] == hit["b"] + 1)))
        joined = F.aggregate(
            beside,
            F.struct(hit["a"].alias("a"), hit["b"].alias("b"), flipped.alias("m")),
            lambda x, r: F.struct(F.least(x["a"], r["a"]).alias("a"), F.greatest(x["b"], r["b"]).alias("b"), x["m"].alias("m")),
        )
        return F.transform(F.array(joined), lambda x: F.concat(F.filter(runs, lambda r: r["b"] < x["a"]), F.array(x), F.filter(runs, lambda r: r["a"] > x["b"])))[0]

    # a transform of the one run that is hit, so that it's looked for once
    made = F.transform(F.filter(runs, lambda r: r["m"].isNotNull() & (r["a"] <= k) & (r["b"] >= k)), put)
    return F.coalesce(F.get(made, F.lit(0)), runs)


def apply_mask_edits(mask: DataFrame, pauses: DataFrame, edits: DataFrame) -> DataFrame:
    """D3: masks after all toggles, in order of `seq`; only pauses of mode `auto` take them.

    mask (video_id, pause_id, k, m), pauses with start_frame, end_frame and mode, edits (video_id,
    frame_idx, seq).  A pause's mask is its runs of equal values; an edit flips one and joins it to its neighbours, so its cost
    goes by runs, and frames come from runs last.  Edits find their pause by blocks of frames.
    """
    p = pauses.where("mode = 'auto'").select("video_id", "pause_id", "start_frame", "end_frame")
    numbered = edits.groupBy("video_id", "frame_idx").agg(F.collect_list("seq").alias("seqs"))
    met = assigned(numbered, p, F.struct("pause_id", "start_frame")).where("info IS NOT NULL").select("video_id", "frame_idx", "info.*")
    edit = F.struct("seq", (F.col("frame_idx") - F.col("start_frame")).alias("k"))
    placed = met.join(numbered, ["video_id", "frame_idx"]).withColumn("seq", F.explode("seqs"))
    lists = placed.groupBy("video_id", "pause_id").agg(F.sort_array(F.collect_list(edit)).alias("edits"))
    done = mask_runs(mask).join(lists, ["video_id", "pause_id"], "left").withColumn(
        "runs", F.when(F.col("edits").isNull(), F.col("runs")).otherwise(F.aggregate("edits", F.col("runs"), lambda m, x: toggled(m, x["k"])))
    )
    each = done.select("video_id", "pause_id", F.explode("runs").alias("r"))
    return each.select("video_id", "pause_id", F.explode(F.sequence(F.col("r.a").cast("int"), F.col("r.b").cast("int"))).alias("k"), F.col("r.m").alias("m"))


def apply_trim_edits(clips: DataFrame, edits: DataFrame) -> DataFrame:
    """keep_in and keep_out after all trims, in order of `seq`; an edge that is crossed moves along.

    edits (video_id, clip_id, seq, side `in` or `out`, f).
    """
    lists = edits.groupBy("video_id", "clip_id").agg(F.sort_array(F.collect_list(F.struct("seq", "side", "f"))).alias("_edits"))
    s, e = F.col("start_frame"), F.col("end_frame")

    def step(a: Column, x: Column) -> Column:
        first = F.greatest(s, F.least(x["f"], e + 1))
        last = F.least(e, F.greatest(x["f"], s - 1))
        moved_in = F.struct(first.alias("ki"), F.when(first > a["ko"], F.least(first - 1, e)).otherwise(a["ko"]).alias("ko"))
        moved_out = F.struct(F.when(last < a["ki"], F.greatest(last + 1, s)).otherwise(a["ki"]).alias("ki"), last.alias("ko"))
        return F.when(x["side"] == "in", moved_in).otherwise(moved_out)

    folded = F.aggregate(
        F.coalesce("_edits", F.array().cast("array<struct<seq:int,side:string,f:bigint>>")),
        F.struct(F.col("keep_in").alias("ki"), F.col("keep_out").alias("ko")),
        step,
    )
    joined = clips.join(lists, ["video_id", "clip_id"], "left").withColumn("_kept", folded)
    return joined.select("video_id", "clip_id", "start_frame", "end_frame", F.col("_kept.ki").alias("keep_in"), F.col("_kept.ko").alias("keep_out"))


def batch_mode_edits(pauses: DataFrame, mode: str, seq: int) -> DataFrame:
    """D1 as edits of every pause, so that it stands in one order with edits of single pauses and of masks."""
    return pauses.select("video_id", "pause_id", F.lit(seq).alias("seq"), F.lit(mode).alias("mode"))


def effective_toggles(pauses: DataFrame, mode_edits: DataFrame, mask_edits: DataFrame) -> DataFrame:
    """Of the toggles (video_id, pause_id, frame_idx, seq) those that count in the end.

    A toggle is taken only while its pause's mode is `auto`, and setting a pause to `auto` computes its mask
    anew, so toggles before the last such edit are lost.  An edit of a mode comes before a toggle of equal seq.
    """
    key = ["video_id", "pause_id"]
    first = pauses.select(*key, F.lit(None).cast("long").alias("seq"), F.lit(0).alias("kind"), "mode", F.lit(None).cast("long").alias("frame_idx"))
    modes = mode_edits.select(*key, F.col("seq").cast("long").alias("seq"), F.lit(1).alias("kind"), "mode", F.lit(None).cast("long").alias("frame_idx"))
    asked = mask_edits.select(*key, F.col("seq").cast("long").alias("seq"), F.lit(2).alias("kind"), F.lit(None).cast("string").alias("mode"), F.col("frame_idx").cast("long").alias("frame_idx"))
    along = W.partitionBy(*key).orderBy(F.col("seq").asc_nulls_first(), "kind")
    rows = first.unionByName(modes).unionByName(asked).withColumn("now", F.last("mode", ignorenulls=True).over(along))
    anew = F.max(F.when((F.col("kind") == 1) & (F.col("mode") == "auto"), F.struct("seq", "kind"))).over(W.partitionBy(*key))
    rows = rows.withColumn("anew", anew).where("kind = 2 AND now = 'auto'").where(F.col("anew").isNull() | (F.struct("seq", "kind") > F.col("anew")))
    return rows.select(*key, "frame_idx", "seq")


def apply_edits(mask: DataFrame, pauses: DataFrame, mode_edits: DataFrame, mask_edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D1-D3 in one order of `seq`: (pauses with their last mode, masks).  mask holds the computed values."""
    toggles = effective_toggles(pauses, mode_edits, mask_edits)
    masks = apply_mask_edits(mask, pauses.withColumn("mode", F.lit("auto")), toggles)
    return apply_mode_edits(pauses, mode_edits), masks
