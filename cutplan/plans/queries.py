"""Named queries over the driver's tables, composed from the operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutplan.functions.frames import clock_label, proc_height
from cutplan.operators import context as C
from cutplan.operators import deletes as D
from cutplan.operators import edits as E
from cutplan.operators import lookup as L
from cutplan.operators import mask as M
from cutplan.operators import outputs as O
from cutplan.operators import pyramid as P
from cutplan.operators import scoring as B
from cutplan.operators import segments as S
from cutplan.plans import fused
from cutplan.plans import runs as R
from cutplan.sources import frames as A
from cutplan.sources import packed, store
from cutplan.sources.params import resolve_params
from cutplan.sources.work import stored, work_dir

FPS, STILL, MOTION, BOUNDARY, FACTOR = 30.0, 3, 100.0, 20.0, 3
THRESHOLDS = (0.4, 0.4, 0.4, 0.4)


class Plan:
    """Frames of one table with everything that follows from them, each part built when it is asked for.

    `plain` and `fast` are runs with what goes, without and with decimation; frames come from them last.
    """

    def __init__(self, frames: DataFrame):
        self.frames = frames

    @cached_property
    def runs(self) -> DataFrame:
        return S.state_runs(self.frames)

    @cached_property
    def plain_pauses(self) -> DataFrame:
        return S.pause_segments(self.runs)

    @cached_property
    def speeds(self) -> DataFrame:
        return S.speed_segments(self.runs)

    @cached_property
    def lengths(self) -> DataFrame:
        return S.totals(self.frames)

    @cached_property
    def clips(self) -> DataFrame:
        return S.clip_segments(self.plain_pauses, self.lengths)

    @cached_property
    def boundaries(self) -> DataFrame:
        return S.boundary_diff(self.plain_pauses, self.frames, self.lengths)

    @cached_property
    def pauses(self) -> DataFrame:
        return S.pause_modes(self.boundaries, BOUNDARY)

    @cached_property
    def mask(self) -> DataFrame:
        return M.pause_mask(M.pause_activity(self.frames, MOTION), F.lit(STILL))

    @cached_property
    def trimmed(self) -> DataFrame:
        return E.apply_trim_edits(self.clips, trim_edits(self.clips))

    @cached_property
    def placed(self) -> DataFrame:
        """Runs with their pause or clip, written once: what follows is derived from them, not from frames again."""
        return stored(R.placed_runs(R.frame_runs(self.frames, MOTION)), "placed")

    @cached_property
    def run_clips(self) -> DataFrame:
        return R.clips(self.placed)

    @cached_property
    def cuts_of_clips(self) -> DataFrame:
        return E.apply_trim_edits(self.run_clips, trim_edits(self.run_clips))

    @cached_property
    def plain(self) -> DataFrame:
        return R.decided(self.placed, self.cuts_of_clips, STILL, BOUNDARY)

    @cached_property
    def fast(self) -> DataFrame:
        return R.decided(self.placed, self.cuts_of_clips, STILL, BOUNDARY, FACTOR, True, True)

    @cached_property
    def base(self) -> DataFrame:
        return R.delete_mask(self.plain)

    @cached_property
    def deleted(self) -> DataFrame:
        return R.delete_mask(self.fast)

    @cached_property
    def ranges(self) -> DataFrame:
        return R.kept_ranges(self.fast)

    @cached_property
    def cuts(self) -> DataFrame:
        return O.cut_list(self.ranges, F.lit(FPS))


def trim_edits(clips: DataFrame) -> DataFrame:
    """One trim a clip, by arithmetic on its numbers, now and then past its edges."""
    size = F.col("end_frame") - F.col("start_frame") + 1
    f = F.col("start_frame") + F.pmod(F.col("video_id") * 13 + F.col("clip_id") * 7, size + 4) - 2
    side = F.when((F.col("video_id") + F.col("clip_id")) % 2 == 0, "in").otherwise("out")
    return clips.select("video_id", "clip_id", F.lit(0).alias("seq"), side.alias("side"), f.alias("f"))


def mode_edits(pauses: DataFrame) -> DataFrame:
    """Two mode edits for every third pause."""
    some = pauses.where((F.col("video_id") + F.col("pause_id")) % 3 == 0)
    pick = lambda n: F.element_at(F.array(F.lit("keep"), F.lit("all"), F.lit("auto")), (n % 3 + 1).cast("int"))
    first = some.select("video_id", "pause_id", F.lit(0).alias("seq"), F.lit("all").alias("mode"))
    return first.unionByName(some.select("video_id", "pause_id", F.lit(1).alias("seq"), pick(F.col("video_id")).alias("mode")))


def mask_edits(pauses: DataFrame, *more: str) -> DataFrame:
    """One toggle a pause."""
    size = F.col("end_frame") - F.col("start_frame") + 1
    f = F.col("start_frame") + F.pmod(F.col("video_id") * 5 + F.col("pause_id"), size)
    return pauses.select("video_id", f.alias("frame_idx"), F.lit(0).alias("seq"), *more)


def video_params(frames: DataFrame) -> DataFrame:
    """Parameters that differ by video, some of them left to their defaults."""
    v = F.col("video_id")
    given = S.totals(frames).select(
        "video_id",
        F.when(v % 4 != 0, (10 + v % 50).cast("double")).alias("fps"),
        F.when(v % 3 != 0, (v % 20).cast("double") / F.lit(100.0)).alias("still_time"),
        F.when(v % 5 != 0, (v % 4 * 90).cast("double")).alias("motion_thresh"),
        F.when(v % 6 != 0, (v % 50).cast("double")).alias("boundary_thresh"),
        F.when(v % 7 != 0, (2 + v % 9).cast("int")).alias("factor_02"),
        F.when(v % 8 != 0, v % 2 == 0).alias("speedup_1x"),
        F.when(v % 9 != 0, v % 4 < 2).alias("speedup_02"),
    )
    return resolve_params(given)


def _delete_mask_params(p: Plan) -> DataFrame:
    params = video_params(p.frames)
    placed = stored(R.placed_runs(R.frame_runs(p.frames.join(params.select("video_id", "motion_thresh"), "video_id"), F.col("motion_thresh"))), "placed")
    clips = R.clips(placed)
    own = [F.col(c) for c in ("still_frames", "boundary_thresh", "factor_02", "speedup_1x", "speedup_02")]
    return R.delete_mask(R.decided(placed.join(params, "video_id"), E.apply_trim_edits(clips, trim_edits(clips)), *own))


def raw_params(frames: DataFrame) -> DataFrame:
    """Parameters per video with gaps and values out of range."""
    v = F.col("video_id")
    return S.totals(frames).select(
        "video_id",
        F.when(v % 4 != 0, (v % 50).cast("double")).alias("fps"),
        F.when(v % 3 != 0, (v % 40).cast("double") / F.lit(100.0)).alias("still_time"),
        F.when(v % 5 != 0, (v % 60).cast("double")).alias("motion_thresh"),
        F.when(v % 6 != 0, (v % 25).cast("int")).alias("factor_02"),
        F.when(v % 7 != 0, v % 2 == 0).alias("speedup_1x"),
    )


def manifest(lengths: DataFrame) -> DataFrame:
    v = F.col("video_id")
    return lengths.select(
        "video_id",
        (F.col("total") + F.pmod(v, F.lit(3)) - 1).alias("declared_frames"),
        (1280 + F.pmod(v, F.lit(5)) * 160).cast("int").alias("src_w"),
        (720 + F.pmod(v, F.lit(4)) * 90).cast("int").alias("src_h"),
        (v % 2 == 0).alias("has_audio"),
    )


def _events(build: Callable[[Plan], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Plan(A.events_frames(spark, sf_dir)))


def _ranges_text(segs: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["a"], r["b"])), ",")
    return segs.select("video_id", F.col("seg_no").cast("long").alias("seg_no"), "label", "name", text.alias("ranges"))


def _outcomes(p: Plan) -> DataFrame:
    segs, v, n = R.segments(p.plain, True, True), F.col("video_id"), F.col("seg_no")
    return segs.select(
        "video_id",
        "seg_no",
        "name",
        ((v + n) % 4).alias("written"),
        ((v * 3 + n) % 5).alias("file_bytes"),
        F.concat(F.lit("error "), F.repeat(F.lit("x"), ((v * n) % 600).cast("int"))).alias("error"),
    )


def _perturbed(p: Plan) -> DataFrame:
    """Contexts of which some are out of date in one way each."""
    ctx, v = C.build_context(p.boundaries, p.lengths), F.col("video_id")
    rec = F.transform(
        "pause_boundary_diffs",
        lambda r: r.withField("end", r["end"] + F.when(v % 11 == 3, 1).otherwise(0)).withField(
            "diff", F.when(v % 11 == 5, F.lit(float("nan"))).otherwise(r["diff"])
        ),
    )
    return ctx.where(v % 11 != 1).select(
        "video_id",
        F.when(v % 11 == 7, 2).otherwise(F.col("version")).alias("version"),
        (F.col("complete") & (v % 11 != 8)).alias("complete"),
        (F.col("frame_count") + F.when(v % 11 == 9, 1).otherwise(0)).alias("frame_count"),
        "decoded_frame_count",
        F.when(v % 11 == 10, F.slice(rec, F.lit(1), F.greatest(F.size(rec) - 1, F.lit(0)))).otherwise(rec).alias("pause_boundary_diffs"),
    )


def _context_rows(p: Plan) -> DataFrame:
    return _flat_context(C.build_context(p.boundaries, p.lengths))


def _flat_context(ctx: DataFrame) -> DataFrame:
    rec = F.array_join(
        F.transform("pause_boundary_diffs", lambda r: F.concat_ws(":", r["start"], r["end"], r["before_index"], r["after_index"])), ","
    )
    total = F.aggregate("pause_boundary_diffs", F.lit(0.0), lambda s, r: s + r["diff"])
    return ctx.select("video_id", "version", "complete", "frame_count", "decoded_frame_count", rec.alias("records"), F.round(total, 4).alias("diff_sum"))


def _embedding(build: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(A.embedding_frames(spark, sf_dir), A.embedding_templates(spark, sf_dir))


def _sources(frames: DataFrame, templates: DataFrame) -> DataFrame:
    """The whole vector that a category's template was cut from."""
    ids = templates.select("ctype", "vec_id")
    return frames.join(ids, "vec_id").select("ctype", "w", "h", "gray")


def _as_8x8(frames: DataFrame, templates: DataFrame) -> DataFrame:
    """Scores of 3 x 3 templates, cut from 8 x 8 pictures and masked by the sign of their pixels."""
    ids = templates.select("ctype", "template_id", "vec_id")
    square = frames.withColumn("w", F.lit(8)).withColumn("h", F.lit(8))
    rows = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda r: F.slice("gray", r * 8 + 3, 3)))
    small = square.join(ids, "vec_id").select(
        "ctype",
        "template_id",
        F.lit(1).alias("roi_x"),
        F.lit(1).alias("roi_y"),
        F.lit(6).alias("roi_w"),
        F.lit(20).alias("roi_h"),
        F.lit(3).alias("tw"),
        F.lit(3).alias("th"),
        rows.alias("t"),
        F.transform(rows, lambda p: p > -0.1).alias("m"),
    )
    scores = B.template_scores(square, small)
    return scores.select("video_id", "frame_idx", "ctype", F.round("score", 4).alias("score"))


def _best(frames: DataFrame, templates: DataFrame) -> DataFrame:
    return B.best_scores(B.template_scores(frames, templates))


def _geometry(p: Plan) -> DataFrame:
    v = F.col("video_id")
    rows = p.lengths.select(
        "video_id",
        F.pmod(v * 17, F.lit(900)).cast("int").alias("x"),
        F.pmod(v * 11, F.lit(500)).cast("int").alias("y"),
        (1 + F.pmod(v * 3, F.lit(160))).cast("int").alias("w"),
        (1 + F.pmod(v * 5, F.lit(90))).cast("int").alias("h"),
        F.lit(1280).alias("source_w"),
        F.lit(720).alias("source_h"),
    )
    done = A.template_geometry(rows, F.lit(400), F.lit(225))
    return done.select("video_id", "roi_x", "roi_y", "roi_w", "roi_h", "tw", "th")


def _proc_height(p: Plan) -> DataFrame:
    m = manifest(p.lengths)
    want = F.when(F.col("video_id") % 3 == 0, 300).otherwise(225)
    return m.select("video_id", proc_height(F.col("src_w"), F.col("src_h"), F.lit(400), want).alias("proc_h"))


def _audit(p: Plan) -> DataFrame:
    short = F.when((F.col("video_id") % 7 == 0) & (F.col("frame_idx") == 3), F.array().cast("array<double>")).otherwise(F.col("gray"))
    # every thirteenth video isn't listed, lists one that has no frames, lacks its frame 5 and has its frame 7 twice
    odd = F.col("video_id") % 13 == 0
    frames = p.frames.where(~(odd & (F.col("frame_idx") == 5))).select("video_id", "frame_idx", F.lit(1).alias("w"), F.lit(1).alias("h"), short.alias("gray"))
    frames = frames.unionByName(frames.where(odd & (F.col("frame_idx") == 7)))
    listed = manifest(p.lengths).withColumn("video_id", F.when(odd, -F.col("video_id") - 1).otherwise(F.col("video_id")))
    return A.audit_frames(frames, listed)


def _usable(frames: DataFrame, templates: DataFrame) -> DataFrame:
    sources = _sources(frames, templates).where("ctype <> 'speed_2x'")
    return A.usable_templates(templates, sources).select("ctype", "template_id", "vec_id")


def _speed(p: Plan) -> DataFrame:
    label, step = L.effective_speed(F.col("state"), F.col("video_id") % 2 == 0, F.lit(True), (F.col("video_id") % 4).cast("int"), F.lit(1.5))
    return p.frames.select("video_id", "frame_idx", label.alias("speed"), step.alias("step"))


#: Viewports (width, zoom, scroll): part of a video, all of it, and one far in.
VIEWS = ((40, 2.0, 0.25), (7, 1.0, 0.0), (100, 13.7, 0.61))


def _viewports(p: Plan) -> DataFrame:
    """All viewports from one pyramid on disk."""
    pyramid = P.write_pyramid(P.build_pyramid(p.deleted), work_dir(p.frames.sparkSession, "pyramid"))
    lengths = stored(p.lengths, "lengths")
    views = [P.viewport_bins(pyramid, lengths, *view).withColumn("view", F.lit(k)) for k, view in enumerate(VIEWS)]
    return reduce(DataFrame.unionByName, views)


def _packed_scripts(p: Plan) -> DataFrame:
    """The cut scripts with sound, written by the packed sink and read back."""
    spark = p.frames.sparkSession
    folder = work_dir(spark, "scripts")
    packed.write_scripts(O.cut_script(O.cut_list(p.ranges, F.lit(25.0)), manifest(p.lengths)), folder)
    return packed.read_scripts(spark, folder)


def _stored_pauses(p: Plan) -> DataFrame:
    """The frames without their differences, written to a store; the pauses from its blocks."""
    kept = store.write_store(p.frames.drop("diff"), work_dir(p.frames.sparkSession, "frame-store"))
    return R.pause_report(R.placed_runs(kept.frame_runs(MOTION)))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = A.events_frames(spark, sf_dir)
    listed = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("video_id"), (F.col("event_id") % 120).alias("frame_idx"))
    return D.deletes_from_list(frames, listed).select("video_id", "frame_idx", "deleted")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")
    return A.number_long_frames(events, "user_id", ["ts", "event_id"]).select("video_id", "frame_idx", "event_id")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutplan.streaming.files import boundaries_of_table

    return boundaries_of_table(A.events_frames(spark, sf_dir))


def _stream_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutplan.streaming.boundaries import context_of_records
    from cutplan.streaming.files import records_of_table

    return _flat_context(context_of_records(records_of_table(A.events_frames(spark, sf_dir))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "state_runs": _events(lambda p: p.runs),
        "state_runs_blocked": _events(lambda p: S.state_runs(p.frames, block=7)),
        "pause_segments": _events(lambda p: p.plain_pauses),
        "speed_segments": _events(lambda p: p.speeds),
        "clip_segments": _events(lambda p: p.clips),
        "frame_diff": _events(lambda p: B.frame_diff(p.frames.drop("diff")).select("video_id", "frame_idx", F.col("diff").cast("double").alias("diff"))),
        "boundary_modes": _events(lambda p: p.pauses),
        "pause_activity": _events(lambda p: M.pause_activity(p.frames, MOTION).select("video_id", "frame_idx", "k", "n", "active")),
        "stored_pauses": _events(_stored_pauses),
        "pause_mask": _events(lambda p: p.mask.withColumn("m", F.col("m").cast("int"))),
        "pause_deletes": _events(lambda p: D.pause_deletes(p.frames, p.pauses, p.mask)),
        "clip_deletes": _events(lambda p: D.clip_deletes(p.frames, p.trimmed)),
        "speedup_deletes": _events(lambda p: D.speedup_deletes(p.frames.select("video_id", "frame_idx", "state", F.lit(False).alias("deleted")), 4, F.lit(FACTOR), F.lit(True))),
        "delete_mask": _events(lambda p: p.deleted),
        "delete_mask_fused": _events(lambda p: fused.delete_mask(p.frames, p.trimmed, STILL, MOTION, BOUNDARY, FACTOR)[1]),
        "delete_mask_params": _events(_delete_mask_params),
        "delete_mask_joined": _events(lambda p: D.delete_mask(D.base_deletes(p.frames, p.pauses, p.mask, p.trimmed), factor_02=FACTOR)),
        "deletes_from_list": _listed,
        "kept_ranges": _events(lambda p: p.ranges),
        "kept_ranges_frames": _events(lambda p: O.kept_ranges(p.deleted)),
        "skip_ranges": _events(lambda p: R.skip_ranges(p.plain, p.cuts_of_clips)),
        "skip_ranges_frames": _events(lambda p: O.skip_ranges(p.pauses, p.mask, p.trimmed)),
        "next_kept": _events(lambda p: R.next_kept(p.plain)),
        "next_kept_frames": _events(lambda p: O.next_kept(p.base)),
        "cut_list": _events(lambda p: p.cuts),
        "cut_script": _events(lambda p: O.cut_script(p.cuts, manifest(p.lengths).withColumn("has_audio", F.lit(False)))),
        "cut_script_audio": _events(lambda p: O.cut_script(O.cut_list(p.ranges, F.lit(25.0)), manifest(p.lengths))),
        "cut_script_packed": _events(_packed_scripts),
        "segments": _events(lambda p: _ranges_text(R.segments(p.plain))),
        "segments_split": _events(lambda p: _ranges_text(R.segments(p.plain, True, True))),
        "segments_unmerged": _events(lambda p: _ranges_text(R.segments(p.plain, False, False))),
        "segments_frames": _events(lambda p: _ranges_text(O.segments(p.base))),
        "edit_summary": _events(lambda p: R.edit_summary(p.fast)),
        "edit_summary_frames": _events(lambda p: O.edit_summary(p.deleted, p.plain_pauses, p.speeds)),
        "export_report": _events(lambda p: O.export_report(_outcomes(p))),
        "frame_info": _events(lambda p: L.frame_info(p.frames, p.pauses, p.speeds)),
        "effective_speed": _events(_speed),
        "clock_label": _events(lambda p: p.frames.select("video_id", "frame_idx", clock_label(F.col("frame_idx") * 997, F.lit(FPS)).alias("clock"))),
        "timeline_bins": _events(lambda p: L.timeline_bins(p.deleted, p.lengths, 40, 2.0, 0.25)),
        "timeline_pyramid": _events(_viewports),
        "audit_frames": _events(_audit),
        "number_frames": _numbered,
        "resolve_params": _events(lambda p: resolve_params(raw_params(p.frames))),
        "template_geometry": _events(_geometry),
        "proc_height": _events(_proc_height),
        "usable_templates": _embedding(_usable),
        "vector_diff": _embedding(lambda f, t: B.frame_diff(f).select("video_id", "frame_idx", F.round(F.col("diff").cast("double"), 4).alias("diff"))),
        "template_scores": _embedding(lambda f, t: B.template_scores(f, t).select("video_id", "frame_idx", "ctype", F.round("score", 4).alias("score"))),
        "template_scores_2d": _embedding(_as_8x8),
        "best_scores": _embedding(lambda f, t: _best(f, t).select("video_id", "frame_idx", *[F.round(c, 4).alias(c) for c in B.CTYPES])),
        "classify": _embedding(lambda f, t: B.classify_frames(f, _best(f, t), THRESHOLDS)),
        "classify_short": _embedding(lambda f, t: B.classify_templates(f, t, THRESHOLDS)),
        "locate_templates": _embedding(lambda f, t: B.locate_templates(_sources(f, t), t).withColumn("score", F.round("score", 4))),
        "template_mask": _embedding(lambda f, t: f.select("vec_id", F.aggregate(B.template_mask(F.transform("gray", lambda x: x * 100)), F.lit(0), lambda n, x: n + x.cast("int")).alias("n_on"))),
        "mode_batch": _events(lambda p: E.apply_mode_batch(p.boundaries, "auto", 300.0)),
        "mode_batch_params": _events(lambda p: E.apply_mode_batch(p.boundaries, "auto", F.col("video_id") % 7 * 100)),
        "mode_edits": _events(lambda p: E.apply_mode_edits(p.pauses, mode_edits(p.pauses))),
        "mask_edits": _events(lambda p: _mask_edits(p)),
        "mode_mask_edits": _events(_mode_mask_edits),
        "trim_edits": _events(lambda p: p.trimmed),
        "validate_context": _events(lambda p: C.validate_context(_perturbed(p), p.plain_pauses, p.lengths)),
        "build_context": _events(_context_rows),
        "reuse_boundaries": _events(lambda p: C.reuse_boundaries(_perturbed(p), p.plain_pauses, p.frames, p.lengths)),
        "stream_boundaries": _stream,
        "stream_context": _stream_context,
    }


def _mask_of_pauses(p: Plan) -> DataFrame:
    mask = p.mask.join(p.plain_pauses.select("video_id", "pause_id", "start_frame"), ["video_id", "start_frame"])
    return mask.select("video_id", "pause_id", F.col("k").cast("int").alias("k"), "m")


def _mode_mask_edits(p: Plan) -> DataFrame:
    """Toggles before, between and after edits of modes, at one place of each pause."""
    place = mask_edits(p.plain_pauses, "pause_id")
    some = (F.col("video_id") + F.col("pause_id")) % 3 == 0
    toggles = place.where(some).drop("seq").withColumn("seq", F.explode(F.array(F.lit(-1), F.lit(1), F.lit(3))))
    toggles = toggles.unionByName(place.where(~some).drop("seq").withColumn("seq", F.lit(3)))
    modes = mode_edits(p.plain_pauses).withColumn("seq", F.col("seq") * 2)
    done, masks = E.apply_edits(_mask_of_pauses(p), p.pauses, modes, toggles)
    both = masks.join(done.select("video_id", "pause_id", "mode"), ["video_id", "pause_id"])
    return both.select("video_id", "pause_id", "mode", "k", F.col("m").cast("int").alias("m"))


def _mask_edits(p: Plan) -> DataFrame:
    done = E.apply_mask_edits(_mask_of_pauses(p), p.pauses, mask_edits(p.plain_pauses))
    return done.select("video_id", "pause_id", "k", F.col("m").cast("int").alias("m"))
