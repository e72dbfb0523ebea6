"""The boundary stream: ends by timer, lost and late frames, restarts, contexts from its records."""

import time

import pytest

from cutplan.operators import context, segments
from cutplan.streaming import boundaries, files

DDL = "video_id long, frame_idx long, state int, gray array<double>, is_last boolean"


def rows(video, states, last=False, skip=()):
    n = len(states)
    return [(video, i, s, [float(10 * i + video)], last and i == n - 1) for i, s in enumerate(states) if i not in skip]


def add(spark, folder, part):
    spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(f"{folder}/frames")


def got(spark, folder, kinds=None):
    found = spark.read.schema(boundaries.OUT).parquet(f"{folder}/records").collect()
    return sorted((r.kind, r.video_id, r.start_frame, r.end_frame, r.diff) for r in found if kinds is None or r.kind in kinds)


def run_until(spark, folder, wanted, **limits):
    query = files.start(spark, f"{folder}/frames", DDL, folder, {"processingTime": "0 seconds"}, **limits)
    until = time.time() + 60
    try:
        while time.time() < until and query.exception() is None:
            time.sleep(0.5)
            if len(got(spark, folder)) >= wanted:
                break
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()


def test_videos_without_a_mark_end_by_timer_over_restarts(spark, tmp_path):
    folder = f"{tmp_path}/s"
    add(spark, folder, rows(1, [0, 1, 1]) + rows(2, [1, 1, 0, 1], skip=(2,)) + rows(3, [0, 1], last=True) + rows(4, [0, 0]))
    before = spark.conf.get(files.SETTING, None)
    run_until(spark, folder, 2, idle_ms=15_000, keep_ms=600_000)
    assert spark.conf.get(files.SETTING, None) == before
    assert got(spark, folder) == [("end", 3, 0, 1, None), ("pause", 3, 1, 1, 10.0)]
    add(spark, folder, rows(1, [0, 1, 1, 1])[3:])
    run_until(spark, folder, 8, idle_ms=15_000, keep_ms=600_000)
    assert got(spark, folder) == [
        ("end", 1, 0, 3, None), ("end", 2, 0, 3, None), ("end", 3, 0, 1, None), ("end", 4, 0, 1, None), ("lost", 2, 2, 2, None),
        ("pause", 1, 1, 3, 30.0), ("pause", 2, 0, 3, 30.0), ("pause", 3, 1, 1, 10.0),
    ]
    # after the end: repeats are dropped, further frames are late
    add(spark, folder, rows(1, [0, 1, 1, 1, 1, 0])[2:])
    run_until(spark, folder, 10, idle_ms=15_000, keep_ms=600_000)
    assert got(spark, folder, {"late"}) == [("late", 1, 4, 4, None), ("late", 1, 5, 5, None)]
    found = {r.video_id: r for r in boundaries.context_of_records(spark.read.schema(boundaries.OUT).parquet(f"{folder}/records")).collect()}
    assert {v: (r.complete, r.frame_count, r.decoded_frame_count, len(r.pause_boundary_diffs)) for v, r in found.items()} == {
        1: (False, 4, 4, 1), 2: (False, 4, 3, 1), 3: (True, 2, 2, 1), 4: (True, 2, 2, 0),
    }


def test_contexts_of_a_whole_stream_are_those_of_the_table(spark):
    part = [r for v in range(6) for r in rows(v, [(v + i // 3) % 2 for i in range(20 + v)])]
    frames = spark.createDataFrame(part, DDL).drop("is_last")
    lengths = segments.totals(frames)
    want = context.build_context(segments.boundary_diff(segments.pause_segments(segments.state_runs(frames)), frames, lengths), lengths)
    made = boundaries.context_of_records(files.records_of_table(frames))
    assert made.columns == want.columns and made.schema["pause_boundary_diffs"].dataType == want.schema["pause_boundary_diffs"].dataType
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(made) == key(want)
    usable = context.validate_context(made, segments.pause_segments(segments.state_runs(frames)), lengths)
    assert all(r.usable for r in usable.collect())


def test_lost_frames_make_the_context_incomplete(spark):
    part = rows(1, [0, 1, 1, 0, 1] * 4, skip=(7,)) + rows(2, [0, 1] * 9)
    frames = spark.createDataFrame(part, DDL).drop("is_last")
    records = files.records_of_table(frames, batches=2, max_held=3)
    made = {r.video_id: (r.complete, r.frame_count, r.decoded_frame_count) for r in boundaries.context_of_records(records).collect()}
    assert made == {1: (False, 20, 19), 2: (True, 18, 18)}


def test_limits_are_checked(spark, tmp_path):
    stream = spark.readStream.schema(DDL).parquet(str(tmp_path))
    with pytest.raises(ValueError, match="keep_ms"):
        boundaries.track(stream, idle_ms=100, keep_ms=100)
    with pytest.raises(ValueError, match="idle_ms"):
        boundaries.track(stream, keep_ms=100)


def test_no_frame_of_a_long_video_is_held_or_lost(spark):
    part = rows(1, [i // 7 % 2 for i in range(200)]) + rows(2, [1] * 3)
    frames = spark.createDataFrame(part, DDL).drop("is_last")
    records = files.records_of_table(frames, max_held=0).collect()
    assert {r.kind for r in records} == {"pause", "end"}
    assert sorted((r.start_frame, r.end_frame) for r in records if r.kind == "pause" and r.video_id == 1) == [(i, min(199, i + 6)) for i in range(7, 200, 14)]


def test_contexts_of_long_videos_are_complete(spark):
    frames = spark.createDataFrame(rows(1, [i // 7 % 2 for i in range(200)]), DDL).drop("is_last")
    made = boundaries.context_of_records(files.records_of_table(frames, max_held=5)).first()
    assert made.complete and made.frame_count == made.decoded_frame_count == 200 and len(made.pause_boundary_diffs) == 14
