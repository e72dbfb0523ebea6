"""Golden cases, worked out by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from cutplan.functions.frames import clock_label
from cutplan.operators import context, deletes, edits, lookup, mask, outputs, scoring, segments
from cutplan.sources import frames as sources
from cutplan.sources.params import resolve_params


def frames_of(spark, states, deleted=None, diffs=None, video=1):
    n = len(states)
    diffs, deleted = diffs or [0.0] * n, deleted or [False] * n
    rows = [(video, i, int(s), float(d), bool(x), [float(i)]) for i, (s, d, x) in enumerate(zip(states, diffs, deleted, strict=True))]
    return spark.createDataFrame(rows, "video_id long, frame_idx long, state int, diff float, deleted boolean, gray array<double>")


def bits(text):
    return [c == "1" for c in text]


MASKS = [
    ([9] + [0] * 9, 3, "0001111000"),
    ([0] * 6, 3, "000000"),
    ([0] * 7, 3, "0001000"),
    ([99] + [0] * 8, 3, "000111000"),
    ([0] * 6 + [5] + [0] * 7, 3, "11000000001111"),
    ([0] * 5 + [5] + [0] * 9 + [5] + [0] * 5, 3, "100000011111000000011"),
    ([0] * 2 + [5] + [0] * 11 + [5] + [0] * 2, 5, "00000111110000000"),
    ([0] * 4 + [2.0] + [0] * 5, 3, "0001111000"),
    ([7], 2, "0"),
    ([0, 5] + [0] * 6, 2, "00001111"),
    ([0] * 7 + [5], 2, "11110000"),
]


def test_pause_masks(spark):
    rows = [(v, i, 1, float(d)) for v, (diffs, _, _) in enumerate(MASKS) for i, d in enumerate(diffs)]
    frames = spark.createDataFrame(rows, "video_id long, frame_idx long, state int, diff float")
    sizes = spark.createDataFrame([(v, sf) for v, (_, sf, _) in enumerate(MASKS)], "video_id long, sf int")
    activity = mask.pause_activity(frames, 2.0).join(sizes, "video_id")
    got = {}
    for r in mask.pause_mask(activity, F.col("sf")).orderBy("video_id", "k").collect():
        got[r.video_id] = got.get(r.video_id, "") + str(r.m)
    assert [got[v] for v in range(len(MASKS))] == [m for *_, m in MASKS]


@pytest.mark.parametrize(
    ("scores", "thr", "state"),
    [
        ((0.7, 0.9, 0.9, 0.9), (0.7,) * 4, 1),
        ((0.1, 0.8, 0.75, 0.9), (0.7,) * 4, 2),
        ((0.1, 0.8, 0.8, 0.9), (0.7,) * 4, 4),
        ((0.1, 0.8, 0.8, 0.1), (0.7,) * 4, 0),
        ((-1.0,) * 4, (0.7,) * 4, 0),
        ((0.1, 0.8, 0.9, 0.1), (0.7, 0.7, 0.95, 0.7), 0),
    ],
)
def test_classification(spark, scores, thr, state):
    row = spark.range(1).select(scoring.classify(*[F.lit(float(s)) for s in scores], thr).alias("state")).first()
    assert row.state == state


def test_scores_that_are_not_finite_are_ignored(spark):
    rows = [(1, 0, "pause", float("nan")), (1, 0, "pause", None), (1, 0, "speed_1x", float("inf")), (1, 0, "speed_1x", 0.25)]
    best = scoring.best_scores(spark.createDataFrame(rows, "video_id long, frame_idx long, ctype string, score double")).first()
    assert (best.pause, best.speed_1x, best.speed_2x) == (-1.0, 0.25, -1.0)


def test_decimation(spark):
    f = frames_of(spark, [4] * 7)
    got = deletes.speedup_deletes(f, 4, F.lit(3), F.lit(True)).orderBy("frame_idx")
    assert [r.deleted for r in got.collect()] == bits("0110110")
    assert [(r.start_frame, r.end_excl) for r in outputs.kept_ranges(got).orderBy("start_frame").collect()] == [(0, 1), (3, 4), (6, 7)]
    restarted = deletes.speedup_deletes(frames_of(spark, [2] * 5, bits("00100")), 2, F.lit(2), F.lit(True)).orderBy("frame_idx")
    assert [r.deleted for r in restarted.collect()] == bits("01101")
    guarded = deletes.speedup_deletes(f, 4, F.lit(1), F.lit(True))
    assert guarded.where("deleted").count() == 0
    assert outputs.kept_ranges(frames_of(spark, [0] * 5, bits("11111"))).count() == 0
    assert [tuple(r)[1:] for r in outputs.kept_ranges(frames_of(spark, [0] * 5)).collect()] == [(0, 5)]


@pytest.mark.parametrize(
    ("moves", "want"),
    [
        ([("in", 15)], (15, 20)),
        ([("in", 5)], (10, 20)),
        ([("in", 30)], (21, 20)),
        ([("out", 5)], (10, 9)),
        ([("in", 15), ("out", 12)], (13, 12)),
    ],
)
def test_trim(spark, moves, want):
    clips = spark.createDataFrame([(1, 0, 10, 20, 10, 20)], "video_id long, clip_id int, start_frame long, end_frame long, keep_in long, keep_out long")
    moved = spark.createDataFrame([(1, 0, i, s, f) for i, (s, f) in enumerate(moves)], "video_id long, clip_id int, seq int, side string, f long")
    row = edits.apply_trim_edits(clips, moved).first()
    assert (row.keep_in, row.keep_out) == want


def test_mask_toggles_in_order(spark):
    masks = spark.createDataFrame([(1, 0, k, m) for k, m in enumerate([0, 0, 1, 1, 0])], "video_id long, pause_id int, k int, m tinyint")
    pauses = spark.createDataFrame([(1, 0, 7, 11, "auto")], "video_id long, pause_id int, start_frame long, end_frame long, mode string")
    toggles = [(1, 9, 0), (1, 7, 1), (1, 10, 2)]
    for n, want in ((1, [0, 0, 3, 3, 0]), (2, [2, 2, 3, 3, 0]), (3, [2, 2, 2, 2, 0])):
        given = spark.createDataFrame(toggles[:n], "video_id long, frame_idx long, seq int")
        got = edits.apply_mask_edits(masks, pauses, given).orderBy("k").collect()
        assert [r.m for r in got] == want
    kept = edits.apply_mask_edits(masks, pauses.withColumn("mode", F.lit("all")), given).orderBy("k").collect()
    assert [r.m for r in kept] == [0, 0, 1, 1, 0]


STATES = [0, 0, 1, 1, 1, 1, 0, 0, 3, 3, 0, 0]


@pytest.mark.parametrize(
    ("gone", "split", "merge", "want"),
    [
        ("000110000000", False, True, "normal[0-1] pause_merged[2-2,5-5] normal[6-11]"),
        ("000110000000", False, False, "normal[0-1] pause[2-2] pause[5-5] normal[6-11]"),
        ("001111000000", False, True, "normal[0-1,6-11]"),
        ("001111000000", True, True, "other[0-1,6-7] 2x[8-9] other[10-11]"),
    ],
)
def test_segments(spark, gone, split, merge, want):
    rows = outputs.segments(frames_of(spark, STATES, bits(gone)), split, merge).orderBy("seg_no").collect()
    text = " ".join(f"{r.label}[{','.join(f'{x.a}-{x.b}' for x in r.ranges)}]" for r in rows)
    assert text == want
    assert [r.name for r in rows] == [f"{i}_{r.label}" for i, r in enumerate(rows, 1)]


def test_segment_names_are_padded(spark):
    rows = spark.createDataFrame([(1, i, "normal") for i in range(1, 13)], "video_id long, seg_no int, label string")
    names = [r.name for r in outputs.segment_names(rows).orderBy("seg_no").collect()]
    assert names[0] == "01_normal" and names[-1] == "12_normal"


def test_clips(spark):
    pauses = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 8, 9)], "video_id long, pause_id int, start_frame long, end_frame long")
    lengths = spark.createDataFrame([(1, 12), (2, 3)], "video_id long, total long")
    got = sorted((r.video_id, r.clip_id, r.start_frame, r.end_frame) for r in segments.clip_segments(pauses, lengths).collect())
    assert got == [(1, 0, 5, 7), (1, 1, 10, 11), (2, 0, 0, 2)]


def test_next_kept(spark):
    got = [r.next_frame for r in outputs.next_kept(frames_of(spark, [0] * 9, bits("001111001"))).orderBy("frame_idx").collect()]
    assert got == [0, 1, 6, 6, 6, 6, 6, 7, 9]


def test_boundaries_at_the_edges(spark):
    for states, want in (([1] * 4 + [0] * 6, (0, 4)), ([0] * 7 + [1] * 3, (6, 9))):
        f = frames_of(spark, states)
        row = segments.boundary_diff(segments.pause_segments(segments.state_runs(f)), f, segments.totals(f)).first()
        assert (row.before_index, row.after_index) == want and row.boundary_diff == want[1] - want[0]


def test_unknown_boundary_is_auto_but_all_in_a_batch(spark):
    pauses = spark.createDataFrame([(1, 0, 0, 4, None)], "video_id long, pause_id int, start_frame long, end_frame long, boundary_diff double")
    assert segments.pause_modes(pauses, 5.0).first()["mode"] == "auto"
    assert edits.apply_mode_batch(pauses, "auto", 5.0).first()["mode"] == "all"
    assert edits.apply_mode_batch(pauses, "keep", 5.0).first()["mode"] == "keep"


@pytest.mark.parametrize("change", ["none", "version", "complete", "count", "missing", "end", "nan"])
def test_contexts(spark, change):
    f = frames_of(spark, [0, 1, 1, 0, 1, 0])
    pauses, lengths = segments.pause_segments(segments.state_runs(f)), segments.totals(f)
    ctx = context.build_context(segments.boundary_diff(pauses, f, lengths), lengths)
    records = F.col("pause_boundary_diffs")
    ctx = {
        "none": lambda: ctx,
        "version": lambda: ctx.withColumn("version", F.lit(2)),
        "complete": lambda: ctx.withColumn("complete", F.lit(False)),
        "count": lambda: ctx.withColumn("frame_count", F.lit(7)),
        "missing": lambda: ctx.withColumn("pause_boundary_diffs", F.slice(records, 1, 1)),
        "end": lambda: ctx.withColumn("pause_boundary_diffs", F.transform(records, lambda r: r.withField("end", r["end"] + 1))),
        "nan": lambda: ctx.withColumn("pause_boundary_diffs", F.transform(records, lambda r: r.withField("diff", F.lit(float("nan"))))),
    }[change]()
    assert context.validate_context(ctx, pauses, lengths).first().usable == (change == "none")


def test_params_cut_in_double_and_defaults(spark):
    rows = spark.createDataFrame([(1, 100.0, 0.29), (2, None, None), (3, 0.0, 5.0)], "video_id long, fps double, still_time double")
    got = {r.video_id: r for r in resolve_params(rows).collect()}
    assert got[1].still_frames == 28 and got[2].still_frames == 3 and got[2].fps == 30.0
    assert got[3].fps == 30.0 and not got[3].in_range and got[2].in_range and got[2].factor_02 == 10


def test_audit(spark):
    f = spark.createDataFrame([(1, 0, 1, 1, [1]), (1, 1, 1, 1, [1]), (2, 0, 2, 1, [1]), (4, 0, 1, 1, None)], sources.FRAMES)
    m = spark.createDataFrame([(1, 3), (2, 1), (3, 5), (4, 1)], "video_id long, declared_frames long")
    got = {r.video_id: r.status for r in sources.audit_frames(f, m).collect()}
    assert got == {1: "short", 2: "bad_payload", 3: "empty", 4: "bad_payload"}


def test_lookup_speed_and_clock(spark):
    f = frames_of(spark, [1, 1, 2, 4, 0])
    runs = segments.state_runs(f)
    pauses = segments.pause_modes(segments.boundary_diff(segments.pause_segments(runs), f, segments.totals(f)), 5.0)
    info = {r.frame_idx: r.kind for r in lookup.frame_info(f, pauses, segments.speed_segments(runs)).collect()}
    assert info == {0: "pause", 1: "pause", 2: "1x", 3: "0.2x", 4: "normal"}
    label, step = lookup.effective_speed(F.col("state"), F.lit(True), F.lit(True), F.lit(1), F.lit(2.0))
    got = [(r.a, r.b) for r in f.orderBy("frame_idx").select(label.alias("a"), step.alias("b")).collect()]
    assert got == [(2.0, 1), (2.0, 1), (4.0, 2), (2.0, 2), (2.0, 1)]
    row = spark.range(1).select(clock_label(F.lit(30 * 6001), F.lit(30.0)).alias("a"), clock_label(F.lit(5), F.lit(0.0)).alias("b")).first()
    assert (row.a, row.b) == ("100:01", "00:00")


def test_export_report_takes_the_first_three(spark):
    rows = [(1, i, f"{i}_x", 0 if i % 2 else 5, 9, "e" * 600) for i in range(1, 10)]
    r = outputs.export_report(spark.createDataFrame(rows, "video_id long, seg_no int, name string, written long, file_bytes long, error string")).first()
    assert (r.total, r.succeeded, r.failed) == (9, 4, 5)
    assert r.details.split("\n") == [f"- {i}_x: " + "e" * 500 for i in (1, 3, 5)]


def test_locate_finds_the_cut_out(spark):
    picture = [float((i * i * 37 + i * 11) % 101) for i in range(48)]
    t = [picture[(3 + r) * 8 + 4 + c] for r in range(2) for c in range(3)]
    src = spark.createDataFrame([("pause", 8, 6, picture)], "ctype string, w int, h int, gray array<double>")
    tpl = spark.createDataFrame([("pause", 0, 3, 2, t)], "ctype string, template_id int, tw int, th int, t array<double>")
    row = scoring.locate_templates(src, tpl).first()
    assert (row.x, row.y) == (4, 3) and row.score > 0.999


def test_flat_frames_and_small_regions_have_no_score(spark):
    f = spark.createDataFrame([(1, 0, 4, 1, [1.0] * 4)], "video_id long, frame_idx long, w int, h int, gray array<double>")
    tpl = [("pause", 0, 0, 0, 4, 1, 2, 1, [1.0, 2.0], [True, True]), ("speed_1x", 0, 3, 0, 4, 1, 2, 1, [1.0, 2.0], [True, True])]
    schema = "ctype string, template_id int, roi_x int, roi_y int, roi_w int, roi_h int, tw int, th int, t array<double>, m array<boolean>"
    rows = scoring.template_scores(f, spark.createDataFrame(tpl, schema)).collect()
    assert [(r.ctype, r.score) for r in rows] == [("pause", None)]
