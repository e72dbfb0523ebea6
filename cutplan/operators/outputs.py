"""Ranges, segments, cut lists, scripts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutplan.functions.frames import PAUSE, speed_label, value

# State names in reports.
STATE_NAMES = {0: "normal", 1: "pause", 2: "1x", 3: "2x", 4: "0_2x"}


def _ranges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Half-open runs of neighbouring frame_idx."""
    group = F.col("frame_idx") - F.row_number().over(W.partitionBy(*keys).orderBy("frame_idx"))
    return (
        rows.withColumn("_g", group)
        .groupBy(*keys, "_g")
        .agg(F.min("frame_idx").alias("start_frame"), (F.max("frame_idx") + 1).alias("end_excl"))
        .drop("_g")
    )


def kept_ranges(frames: DataFrame) -> DataFrame:
    """(video_id, start_frame, end_excl) of frames that aren't deleted."""
    return _ranges(frames.where(~F.col("deleted")).select("video_id", "frame_idx"), ["video_id"])


def skip_ranges(pauses: DataFrame, mask: DataFrame, clips: DataFrame) -> DataFrame:
    """what playback jumps over before decimation, half-open: whole pauses of mode `all`, deleted
    runs of pauses of mode `auto`, cut-off edges of clips."""
    whole = pauses.where("mode = 'all'").select("video_id", "start_frame", (F.col("end_frame") + 1).alias("end_excl"))
    auto = pauses.where("mode = 'auto'").select("video_id", F.col("start_frame").alias("p"))
    gone = mask.where(F.col("m").isin(1, 2)).select("video_id", F.col("start_frame").alias("p"), "frame_idx").join(auto, ["video_id", "p"])
    parts = _ranges(gone, ["video_id", "p"]).select("video_id", "start_frame", "end_excl")
    return whole.unionByName(parts).unionByName(trimmed_edges(clips))


def trimmed_edges(clips: DataFrame) -> DataFrame:
    """What trims cut off clips, half-open; all of a clip whose edges have crossed."""
    cut = F.col("keep_in") > F.col("keep_out")
    edges = clips.select(
        "video_id",
        F.explode(
            F.when(cut, F.array(F.struct(F.col("start_frame").alias("s"), (F.col("end_frame") + 1).alias("e")))).otherwise(
                F.array(
                    F.struct(F.col("start_frame").alias("s"), F.col("keep_in").alias("e")),
                    F.struct((F.col("keep_out") + 1).alias("s"), (F.col("end_frame") + 1).alias("e")),
                )
            )
        ).alias("r"),
    )
    return edges.where("r.s < r.e").select("video_id", F.col("r.s").alias("start_frame"), F.col("r.e").alias("end_excl"))


def next_kept(frames: DataFrame) -> DataFrame:
    """for each frame the first one at or after it that isn't deleted, or the video's length."""
    onward = W.partitionBy("video_id").orderBy("frame_idx").rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.count(F.lit(1)).over(W.partitionBy("video_id"))
    found = F.min(F.when(~F.col("deleted"), F.col("frame_idx"))).over(onward)
    return frames.select("video_id", "frame_idx", F.coalesce(found, total).alias("next_frame"))


def segments(frames: DataFrame, split_by_speed: bool | Column = False, merge_pause: bool | Column = True) -> DataFrame:
    """Labelled segments of kept frames, (video_id, seg_no, label, name, ranges: array<struct<a, b>>).

    A fragment ends at a deletion, at a pause's edge and, if split, at a speed change.  Fragments of a
    pause are one segment if merged; neighbouring fragments with one label that isn't a pause's are one
    segment, also across deleted frames.
    """
    other = F.when(value(split_by_speed, "boolean"), speed_label(F.col("state"))).otherwise("normal")
    label = F.when(F.col("state") == PAUSE, F.when(value(merge_pause, "boolean"), "pause_merged").otherwise("pause")).otherwise(other)
    paused = W.partitionBy("video_id", "_is_pause").orderBy("frame_idx")
    runs = (
        frames.withColumn("_is_pause", F.col("state") == PAUSE)
        .withColumn("_g", F.col("frame_idx") - F.row_number().over(paused))
        .withColumn("_ps", F.min("frame_idx").over(W.partitionBy("video_id", "_is_pause", "_g")))
    )
    kept = runs.where(~F.col("deleted"))
    i = F.col("frame_idx")
    return joined_fragments(kept.select("video_id", label.alias("label"), F.when(F.col("_is_pause"), F.col("_ps")).alias("ps"), i.alias("a"), i.alias("b")))


def joined_fragments(parts: DataFrame) -> DataFrame:
    """F4-F8 from parts (video_id, label, ps, a, b) of kept frames, a to b; ps is the start of a pause's part."""
    by_frame = W.partitionBy("video_id").orderBy("a")
    goes_on = (F.lag("b").over(by_frame) == F.col("a") - 1) & (F.lag("label").over(by_frame) == F.col("label"))
    numbered = parts.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("frag", F.sum("_new").over(by_frame))
    frags = numbered.groupBy("video_id", "frag").agg(
        F.first("label").alias("label"), F.min("a").alias("a"), F.max("b").alias("b"), F.min("ps").alias("ps")
    )
    by_frag = W.partitionBy("video_id").orderBy("frag")
    same = F.lag("label").over(by_frag) == F.col("label")
    joins = same & (~F.col("label").startswith("pause") | ((F.col("label") == "pause_merged") & (F.lag("ps").over(by_frag) == F.col("ps"))))
    grouped = frags.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("seg_no", F.sum("_new").over(by_frag))
    whole = grouped.groupBy("video_id", "seg_no").agg(F.first("label").alias("label"), F.sort_array(F.collect_list(F.struct("a", "b"))).alias("ranges"))
    return segment_names(whole)


def segment_names(whole: DataFrame) -> DataFrame:
    """F8: adds `name`, the number padded to the width of the video's count of segments, `_` and the label."""
    count = F.count(F.lit(1)).over(W.partitionBy("video_id"))
    width = F.length(count.cast("string"))
    return whole.withColumn("name", F.concat(F.lpad(F.col("seg_no").cast("string"), width, "0"), F.lit("_"), F.col("label")))


def cut_list(ranges: DataFrame, fps: Column) -> DataFrame:
    """ranges numbered in time order from 0, in frames and seconds, with the video's kept frames."""
    by_time = W.partitionBy("video_id").orderBy("start_frame")
    return ranges.select(
        "video_id",
        (F.row_number().over(by_time) - 1).alias("cut_no"),
        "start_frame",
        "end_excl",
        (F.col("start_frame").cast("double") / fps).alias("start_s"),
        (F.col("end_excl").cast("double") / fps).alias("end_s"),
        F.sum(F.col("end_excl") - F.col("start_frame")).over(W.partitionBy("video_id")).alias("frames_kept"),
    )


def cut_script(cuts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(video_id, script): a trim line per range, with sound if the video has any, then the concat line."""
    joined = cuts.join(manifest.select("video_id", "has_audio"), "video_id", "left").withColumn("_audio", F.coalesce("has_audio", F.lit(False)))
    video = F.format_string("[0:v]trim=start_frame=%d:end_frame=%d,setpts=PTS-STARTPTS[v%d]", "start_frame", "end_excl", "cut_no")
    audio = F.format_string("[0:a]atrim=start=%.9f:end=%.9f,asetpts=PTS-STARTPTS[a%d]", "start_s", "end_s", "cut_no")
    lines = F.when(F.col("_audio"), F.concat_ws(";\n", video, audio)).otherwise(video)
    inputs = F.when(F.col("_audio"), F.format_string("[v%d][a%d]", "cut_no", "cut_no")).otherwise(F.format_string("[v%d]", "cut_no"))
    per = joined.groupBy("video_id").agg(
        F.sort_array(F.collect_list(F.struct("cut_no", lines.alias("line"), inputs.alias("ins")))).alias("_p"), F.first("_audio").alias("_audio")
    )
    concat = F.concat(
        F.array_join(F.transform("_p", lambda x: x["ins"]), ""),
        F.lit("concat=n="),
        F.size("_p").cast("string"),
        F.when(F.col("_audio"), ":v=1:a=1[outv][outa]").otherwise(":v=1:a=0[outv]"),
    )
    return per.select("video_id", F.concat(F.array_join(F.transform("_p", lambda x: x["line"]), ";\n"), F.lit(";\n"), concat).alias("script"))


def write_scripts(scripts: DataFrame, path: str) -> None:
    """F10's sink: a text file per video, below video_id=..."""
    scripts.select("video_id", "script").repartition("video_id").write.partitionBy("video_id").text(path)


def edit_summary(frames: DataFrame, pauses: DataFrame, speeds: DataFrame) -> DataFrame:
    """per video its pauses, speed sections, frames, kept and deleted frames, and kept frames by state."""
    kept = ~F.col("deleted")
    counts = frames.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(kept).alias("kept"),
        F.count_if(F.col("deleted")).alias("gone"),
        *[F.count_if(kept & (F.col("state") == s)).alias(f"kept_{name}") for s, name in STATE_NAMES.items()],
    )
    n = lambda rows, name: rows.groupBy("video_id").agg(F.count(F.lit(1)).alias(name))
    joined = counts.join(n(pauses, "n_pauses"), "video_id", "left").join(n(speeds, "n_speeds"), "video_id", "left")
    return joined.fillna(0, ["n_pauses", "n_speeds"])


def export_report(outcomes: DataFrame) -> DataFrame:
    """per video the counts of exported segments and the first three failures, errors cut to 500 characters.

    outcomes (video_id, seg_no, name, written, file_bytes, error); a success wrote frames and bytes.
    """
    ok = F.coalesce((F.col("written") > 0) & (F.col("file_bytes") > 0), F.lit(False))
    marked = outcomes.withColumn("ok", ok)
    counts = marked.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed")
    )
    first = W.partitionBy("video_id").orderBy("seg_no")
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.substring(F.coalesce("error", F.lit("")), 1, 500))
    top = marked.where(~F.col("ok")).withColumn("rn", F.row_number().over(first)).where("rn <= 3")
    details = top.groupBy("video_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", line.alias("line")))), lambda x: x["line"]), "\n").alias("details")
    )
    return counts.join(details, "video_id", "left").withColumn("details", F.coalesce("details", F.lit("")))
