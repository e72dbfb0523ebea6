"""Plans on runs against the operators on frames, blocks of long videos, template scores against loops, sources and sinks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutplan.operators import deletes, edits, mask, outputs, scoring, segments
from cutplan.plans import runs as R
from cutplan.sources import frames as sources
from cutplan.sources.params import resolve_params

SCHEMA = "video_id long, frame_idx long, state int, diff float, gray array<double>"


def videos(seed, count=25):
    rng, rows = random.Random(seed), []
    for v in range(count):
        state, i = rng.randrange(5), 0
        for _ in range(rng.randrange(1, 12)):
            state = rng.choice([0, 1, 1, 1, 2, 3, 4, 4])
            for _ in range(rng.randrange(1, 16)):
                rows.append((v, i, state, rng.choice([0.0, 1.0, 5.0, 9.0]), [float(rng.randrange(30))]))
                i += 1
    return rows


def plan_on_runs(frames, block, still, motion, boundary, factor):
    placed = R.placed_runs(R.frame_runs(frames, motion, block))
    clips = R.clips(placed)
    trims = clips.select("video_id", "clip_id", F.lit(0).alias("seq"), F.lit("in").alias("side"), (F.col("start_frame") + F.col("clip_id") * 3 - 1).alias("f"))
    trimmed = edits.apply_trim_edits(clips, trims)
    return R.decided(placed, trimmed, still, boundary), R.decided(placed, trimmed, still, boundary, factor, True, True), trimmed


def plan_on_frames(frames, trimmed, still, motion, boundary, factor):
    pauses = segments.pause_segments(segments.state_runs(frames))
    pauses = segments.pause_modes(segments.boundary_diff(pauses, frames, segments.totals(frames)), boundary)
    base = deletes.base_deletes(frames, pauses, mask.pause_mask(mask.pause_activity(frames, motion), F.lit(still)), trimmed)
    return base, deletes.delete_mask(base, factor_02=factor)


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_runs_equal_frames(spark, block):
    frames = spark.createDataFrame(videos(block), SCHEMA).cache()
    still, motion, boundary, factor = 2, 4.0, 6.0, 3
    plain, fast, trimmed = plan_on_runs(frames, block, still, motion, boundary, factor)
    base, deleted = plan_on_frames(frames, trimmed, still, motion, boundary, factor)
    base, deleted = base.cache(), deleted.cache()
    assert rows_of(R.delete_mask(plain)) == rows_of(base) and rows_of(R.delete_mask(fast)) == rows_of(deleted)
    assert rows_of(R.kept_ranges(fast)) == rows_of(outputs.kept_ranges(deleted))
    assert rows_of(R.next_kept(plain)) == rows_of(outputs.next_kept(base))
    for split, merge in ((False, True), (True, False)):
        assert rows_of(R.segments(plain, split, merge)) == rows_of(outputs.segments(base, split, merge))
    runs = segments.state_runs(frames)
    summary = outputs.edit_summary(deleted, segments.pause_segments(runs), segments.speed_segments(runs))
    assert rows_of(R.edit_summary(fast)) == rows_of(summary)


def test_one_long_video_in_blocks(spark):
    n, block = 1_000_000, 50_000
    i = F.col("id")
    frames = spark.range(0, n, 1, 16).select(
        F.lit(1).cast("long").alias("video_id"), i.alias("frame_idx"), F.floor(i / 70_000 % 2).cast("int").alias("state"), (i % 9999 == 0).cast("float").alias("diff"),
        F.array((i % 100).cast("double")).alias("gray"),
    )
    dealt = segments.blocked(frames, block).groupBy("_block").count()
    assert dealt.agg(F.max("count")).first()[0] <= block + 2
    runs = R.frame_runs(frames, 0.5, block)
    got = sorted((r.s, r.e, r.state, r.active) for r in runs.collect())
    assert got[0][0] == 0 and got[-1][1] == n - 1 and all(a[1] + 1 == b[0] for a, b in zip(got, got[1:], strict=False))
    state = np.arange(n) // 70_000 % 2
    moved = np.arange(n) % 9999 == 0
    own = moved & (np.concatenate([[0], state[:-1]]) == 1)
    ahead = np.concatenate([moved[1:], [False]]) & (np.concatenate([state[1:], [0]]) == 1)
    active = (state == 1) & (own | ahead)
    edge = np.flatnonzero((state[1:] != state[:-1]) | (active[1:] != active[:-1])) + 1
    starts = [0, *edge.tolist()]
    assert got == [(s, e, int(state[s]), bool(active[s])) for s, e in zip(starts, [*(edge - 1).tolist(), n - 1], strict=True)]
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "_block" in plan
    diffs = scoring.frame_diff(frames.drop("diff"), block).where(F.col("diff") != F.when(i_of() == 0, 0.0).when(i_of() % 100 == 0, 99.0).otherwise(1.0))
    assert diffs.count() == 0


def i_of():
    return F.col("frame_idx")


def naive_score(picture, t, on, roi):
    x0, y0, w, h = roi
    part = picture[y0 : y0 + h, x0 : x0 + w].astype(float)
    best = (-math.inf, None, None)
    for y in range(part.shape[0] - t.shape[0] + 1):
        for x in range(part.shape[1] - t.shape[1] + 1):
            p, q = part[y : y + t.shape[0], x : x + t.shape[1]][on], t[on].astype(float)
            a, b = p - p.mean(), q - q.mean()
            if (a * a).sum() > 1e-9 and (b * b).sum() > 1e-9:
                r = float((a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum()))
                if r > best[0] + 1e-6:
                    best = (r, x0 + x, y0 + y)
    return best


@pytest.mark.parametrize(("kind", "cells"), [("binary", 1 << 20), ("array<smallint>", 1 << 20), ("array<double>", 1 << 20), ("binary", 0), ("array<double>", 0)])
def test_template_scores_equal_loops(spark, monkeypatch, kind, cells):
    monkeypatch.setattr(scoring, "MATRIX_CELLS", cells)
    rng = np.random.default_rng(len(kind))
    pictures = {(0, i): rng.integers(0, 256, (20, 30)) for i in range(6)} | {(1, 0): rng.integers(0, 256, (12, 17)), (1, 1): np.full((20, 30), 7)}
    pictures[0, 4] = np.tile(pictures[0, 3][:5, :6], (4, 5))
    rows = []
    for (v, i), p in pictures.items():
        flat = p.ravel().tolist()
        rows.append((v, i, p.shape[1], p.shape[0], bytes(flat) if kind == "binary" else [float(x) if "double" in kind else x for x in flat]))
    rows.append((2, 0, 30, 20, bytes(5) if kind == "binary" else [1, 2] if "small" in kind else [1.0]))
    frames = spark.createDataFrame(rows, f"video_id long, frame_idx long, w int, h int, gray {kind}")
    tpl, made = [], {}
    for k, (ctype, roi, size) in enumerate([("pause", (2, 3, 14, 9), (6, 5)), ("pause", (0, 0, 99, 99), (6, 5)), ("speed_1x", (10, 4, 15, 15), (4, 7)), ("speed_2x", (25, 15, 9, 9), (8, 8))]):
        t = pictures[0, 3][3 : 3 + size[1], 4 : 4 + size[0]]
        t = np.pad(t, ((0, size[1] - t.shape[0]), (0, size[0] - t.shape[1])))
        on = rng.random(t.shape) > 0.3 if k % 2 else np.ones(t.shape, bool)
        made[ctype, k] = (t, on, roi)
        tpl.append((ctype, k, *roi, *size, [int(x) for x in t.ravel()], on.ravel().tolist()))
    templates = spark.createDataFrame(tpl, "ctype string, template_id int, roi_x int, roi_y int, roi_w int, roi_h int, tw int, th int, t array<int>, m array<boolean>")
    got = {(r.video_id, r.frame_idx, r.ctype, r.template_id): r for r in scoring.template_scores(frames, templates).collect()}
    seen = 0
    for (v, i), p in pictures.items():
        for (ctype, k), (t, on, roi) in made.items():
            r = got.get((v, i, ctype, k))
            h, w = min(roi[3], p.shape[0] - roi[1]), min(roi[2], p.shape[1] - roi[0])
            if h < t.shape[0] or w < t.shape[1]:
                assert r is None
                continue
            score, x, y = naive_score(p, t, on, roi)
            seen += 1
            if x is None:
                assert r.score is None
            else:
                assert abs(r.score - score) < 1e-5 and (r.x, r.y) == (x, y), (kind, v, i, ctype, k)
    assert len(got) == seen
    thr = (0.6, 0.5, 0.5, 0.5)
    one = {(r.video_id, r.frame_idx): r.state for r in scoring.classify_templates(frames, templates, thr).collect()}
    many = {(r.video_id, r.frame_idx): r.state for r in scoring.classify_frames(frames, scoring.best_scores(scoring.template_scores(frames, templates)), thr).collect()}
    assert {k: s for k, s in many.items() if k[0] < 2} == one
    assert {r.state for r in scoring.classify_templates(frames, templates, (F.lit(2.0), F.lit(2.0), F.lit(2.0), F.col("video_id") - 9.0)).collect()} <= {0, 4}


def test_thresholds_and_modes_by_video(spark):
    params = resolve_params(spark.createDataFrame([(0, 1.0, 0.5), (1, 9.0, 50.0)], "video_id long, motion_thresh double, boundary_thresh double"))
    frames = spark.createDataFrame(videos(3, 2), SCHEMA)
    own = R.placed_runs(R.frame_runs(frames.join(params.select("video_id", "motion_thresh"), "video_id"), F.col("motion_thresh"))).join(params, "video_id")
    mixed = R.delete_mask(R.decided(own, None, F.col("still_frames"), F.col("boundary_thresh"), F.col("factor_02"), F.col("speedup_1x"), F.col("speedup_02")))
    for p in params.collect():
        here = frames.where(F.col("video_id") == p.video_id)
        placed = R.placed_runs(R.frame_runs(here, p.motion_thresh))
        alone = R.delete_mask(R.decided(placed, None, p.still_frames, p.boundary_thresh, p.factor_02, p.speedup_1x, p.speedup_02))
        assert rows_of(alone) == rows_of(mixed.where(F.col("video_id") == p.video_id))


def test_stored_frames_and_written_scripts(spark, tmp_path):
    rows = [(v, i, 2, 1, [v, i]) for v in range(2) for i in range(4)]
    spark.createDataFrame(rows, sources.FRAMES).write.parquet(f"{tmp_path}/frames")
    frames = sources.read_frames(spark, f"{tmp_path}/frames")
    assert frames.schema == sources.FRAMES and rows_of(frames) == sorted((i, g, 1, v, 2) for v, i, _, _, g in rows)
    cuts = outputs.cut_list(outputs.kept_ranges(frames.withColumn("deleted", F.col("frame_idx") == 1)), F.lit(25.0))
    manifest = spark.createDataFrame([(0, True, 1280, 720), (1, False, 800, 600)], "video_id long, has_audio boolean, src_w int, src_h int")
    scripts = outputs.cut_script(cuts, manifest)
    outputs.write_scripts(scripts, f"{tmp_path}/scripts")
    back = spark.read.text(f"{tmp_path}/scripts", wholetext=True)
    assert {r.video_id: r.value.rstrip("\n") for r in back.collect()} == {r.video_id: r.script for r in scripts.collect()}
    sizes = sources.processing_size(manifest, resolve_params(manifest.select("video_id")))
    assert rows_of(sizes) == sorted([(225, 400, 0), (300, 400, 1)])


def test_lost_frames_end_in_the_stream(spark):
    from cutplan.streaming.boundaries import BoundaryTracker

    class Value:
        def __init__(self):
            self.x = None

        def exists(self):
            return self.x is not None

        def get(self):
            return self.x

        def update(self, x):
            self.x = x

        put = update

        def clear(self):
            self.x = None

    import pandas as pd

    tracker = BoundaryTracker(max_held=3)
    tracker.place, tracker.held = Value(), Value()

    def feed(*rows):
        part = pd.DataFrame([(i, s, np.array([float(g)]), last) for i, s, g, last in rows], columns=["frame_idx", "state", "gray", "is_last"])
        return [tuple(r[1:]) for out in tracker.handleInputRows((7,), iter([part]), None) for r in out.itertuples(index=False) if r.kind == "pause"]

    assert feed((0, 0, 1, False), (1, 1, 2, False)) == []
    assert feed((3, 1, 4, False), (4, 0, 9, False)) == [] and len(tracker.held.x) == 2
    assert feed((5, 1, 9, False), (6, 1, 9, True)) == [(7, 1, 3, 0, 4, 8.0), (7, 5, 6, 4, 6, 0.0)]


def test_kernel_sums_equal_plain_correlations():
    """Masked and full templates on bytes of low and high contrast, numbers, and regions of several sizes."""
    rng = np.random.default_rng(3)
    for h, w, th, tw in [(9, 14, 4, 6), (30, 41, 25, 40), (60, 70, 33, 33), (200, 230, 40, 60)]:
        kinds = [
            rng.integers(0, 256, (2, h, w)).astype(np.uint8),
            (255 * (np.arange(w) > w // 2) * np.ones((2, h, 1))).astype(np.uint8),
            (10 + rng.integers(0, 2, (2, h, w))).astype(np.uint8),
            np.full((2, h, w), 77, np.uint8),
            rng.integers(0, 256, (2, h, w)).astype(np.float64) / 3,
        ]
        for region in kinds:
            for on in (np.ones((th, tw), bool), rng.random((th, tw)) > 0.2):
                t = rng.integers(0, 256, (th, tw)).astype(float)
                got = scoring.Pictures(region).scores(scoring.Template(t, on))
                z = (t - t[on].mean())[on]
                for y in {0, (h - th) // 2, h - th}:
                    for x in {0, (w - tw) // 2, w - tw}:
                        for k in range(2):
                            p = region[k, y : y + th, x : x + tw].astype(float)[on]
                            if p.max() == p.min():
                                assert got[k, y, x] == -np.inf
                            else:
                                want = (p - p.mean()) @ z / np.sqrt(((p - p.mean()) ** 2).sum() * (z @ z))
                                assert abs(got[k, y, x] - want) < 2e-5


@pytest.mark.parametrize("seed", range(6))
def test_pruned_scores_equal_scores_of_all_placements(seed):
    rng = np.random.default_rng(seed)
    th, tw = [(8, 12), (25, 40), (5, 5), (9, 4), (1, 9), (12, 1)][seed]
    smooth = lambda h, w: np.add.outer(np.cumsum(rng.normal(0, 9, h)), np.cumsum(rng.normal(0, 9, w))) + 128
    t = np.clip(smooth(th, tw), 0, 255).round()
    on = np.ones((th, tw), bool)
    if seed % 2:
        on[: th // 3, : tw // 2] = False
    template = scoring.Template(t, on)
    pictures = np.stack([np.clip(smooth(th + 20, tw + 30) if k % 2 else rng.integers(0, 256, (th + 20, tw + 30)), 0, 255) for k in range(12)]).astype(np.uint8)
    pictures[3, 4 : 4 + th, 5 : 5 + tw] = t
    if 2 * th + 4 <= th + 20:
        pictures[3, 4 + th : 4 + 2 * th, 5 : 5 + tw] = t
    pictures[5] = 0
    pictures[6, :, : tw // 2 + 10] = 255
    pictures[7] = 200
    pictures[7, 3, 3] = 201
    made = scoring.Pictures(pictures)
    every = made.scores(template).reshape(len(pictures), -1)
    top, first = every.max(1), np.round(every, 5).argmax(1)
    for floor in (-np.inf, -0.5, 0.3, 0.7, 0.95):
        score, place = scoring.Pictures(pictures).best(template, np.full(len(pictures), floor))
        above = top >= floor
        assert np.isinf(score[~above]).all() or (score[~above] < floor + 1e-5).all()
        sure = np.isfinite(top) & (top > floor + 1e-5)
        assert np.abs(score[sure] - top[sure]).max(initial=0) < 1e-5
        assert (np.abs(every[sure, place[sure]] - top[sure]) < 2e-5).all()
        assert (place[sure] <= first[sure]).all() or np.abs(every[sure, place[sure]] - every[sure, first[sure]]).max() < 2e-5
    assert np.isinf(top[5])
    if seed < 3:
        found = made.candidates(template, np.full(len(pictures), 0.9))
        assert found is not None and 0 < len(found[0]) < every.size / 2


def test_banded_frames_read_only_the_bands_of_a_region(spark, tmp_path):
    from cutplan.sources import bands

    rng = np.random.default_rng(3)
    rows = [(0, i, w, h, bytes(rng.integers(0, 256, w * h).tolist())) for i, (w, h) in enumerate([(30, 20)] * 5 + [(17, 9), (30, 31), (3, 2)])]
    rows.append((1, 0, 30, 20, None))
    frames = spark.createDataFrame(rows, "video_id long, frame_idx long, w int, h int, gray binary")
    bands.banded(frames, 8, 32).write.parquet(f"{tmp_path}/bands")
    stored = spark.read.parquet(f"{tmp_path}/bands")
    assert sorted(map(tuple, bands.whole(stored).collect()), key=str) == sorted(((v, i, w, h, g and bytearray(g)) for v, i, w, h, g in rows), key=str)
    picture = np.frombuffer(rows[2][4], np.uint8).reshape(20, 30)
    t = picture[10:15, 4:11].ravel().tolist()
    ddl = "ctype string, template_id int, roi_x int, roi_y int, roi_w int, roi_h int, tw int, th int, t array<int>, m array<boolean>"
    templates = spark.createDataFrame([("pause", 0, 2, 9, 20, 7, 7, 5, t, [True] * 35), ("speed_1x", 1, 0, 9, 30, 7, 7, 5, t[::-1], [True] * 35)], ddl)
    thr = (0.9, 0.2, 0.9, 0.9)
    got = scoring.classify_templates(stored, templates, thr)
    assert sorted(map(tuple, got.where("frame_idx <> 7").collect())) == sorted(map(tuple, scoring.classify_templates(frames, templates, thr).where("frame_idx <> 7").collect()))
    assert {(r.video_id, r.frame_idx) for r in got.where("state = 1").collect()} == {(0, 2)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "gray_8_16" in plan and "gray_24_32" not in plan and "gray_0_8" not in plan
    with pytest.raises(Exception, match="more than 16 rows"):
        bands.banded(frames, 8, 16).collect()
